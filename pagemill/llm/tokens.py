"""Token ids of whole texts by a public tokenizer file, a word at a time.

BPE merges never cross the boundary before a white space that follows a word, so a
text is cut there and the ids of a piece are asked from the tokenizers library once
for each worker and kept. Pieces of plain Latin letters with punctuation behind are
cut once more before the punctuation. Texts with other white space than ASCII's are
encoded whole, because a run of it can join pieces.
"""

from __future__ import annotations

import os
import re

import numpy as np

KEPT = 700_000  # pieces of a generation; a worker remembers two
TEXTS = 256  # texts whose new pieces are asked for together
RARE_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
# İ folds to two characters, the second of which goes with the marks behind it
LETTERS_THEN_MARKS = re.compile(r"([\x20\x09-\x0D]?[A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([.,!?;:]*)")


class Pieces(dict):
    """piece -> its ids, as little-endian unsigned 32-bit numbers."""

    def __init__(self, tokenizer) -> None:
        super().__init__()
        self.tokenizer = tokenizer
        self.missed: list[str] = []
        self.older: dict[str, bytes] = {}
        self.folds = self.ask("A") == self.ask("a")
        special = [(i, t.content) for i, t in tokenizer.get_added_tokens_decoder().items() if t.special]
        self.mark_id, self.mark = special[0] if special else (None, None)

    def ask(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ask_all(self, pieces: list[str]) -> dict[str, bytes]:
        """Asks for many pieces at once, with a special token between them."""
        if self.mark is None:
            return {p: self.ask(p) for p in pieces}
        out = {}
        groups = [pieces[i : i + 500] for i in range(0, len(pieces), 500)]
        texts = [self.mark.join([*g, ""]) for g in groups]
        for group, made in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(made.ids, "<u4")
            ends = np.flatnonzero(ids == self.mark_id).tolist()
            data = ids.tobytes()
            out.update((p, data[4 * a + 4 : 4 * z]) for p, a, z in zip(group, [-1, *ends], ends))
        return out

    def learn(self) -> dict[str, bytes]:
        """The pieces that were missed since the last call, with their ids."""
        if len(self) > KEPT:  # what is not met again in a generation is forgotten
            self.older = dict(self)
            self.clear()
        new = set(self.missed)
        self.missed.clear()
        split = {}
        for piece in new:
            m = LETTERS_THEN_MARKS.fullmatch(piece)
            if m:  # these letters fold one by one, whatever stands around them
                split[piece] = (m[1].lower() if self.folds else m[1], m[2])
        parts = new.difference(split).union(*split.values())
        parts.discard("")
        found = {p: i for p in parts if (i := self.get(p) or self.older.get(p)) is not None}
        odd = [p for p in parts if "<" in p]  # could hold a special token
        found.update((p, self.ask(p)) for p in odd)
        found.update(self.ask_all([p for p in parts if p not in found]))
        found[""] = b""
        found.update([(p, found[a] + found[b]) for p, (a, b) in split.items()])
        self.update(found)
        return found

    def __missing__(self, piece: str) -> bytes | None:
        ids = self.older.get(piece)
        if ids is None:
            self.missed.append(piece)
        else:
            self[piece] = ids
        return ids


class Encoder:
    """path: a file of the tokenizers library, present on every machine."""

    kept: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.pieces = Pieces(Tokenizer.from_file(path))
        self.size = self.pieces.tokenizer.get_vocab_size()
        drops = self.pieces.ask("a b") == self.pieces.ask("a\n\n b")
        self.cut = self._words if drops else self._spaced

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One for each worker process, so that pieces are remembered across tasks."""
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    @staticmethod
    def _words(text: str) -> list[str]:
        return text.split()

    @staticmethod
    def _spaced(text: str) -> list[str]:
        """Every piece is white space and the word behind it."""
        if "\0" in text:
            return [text]
        if "\t" in text or "\r" in text or "\x0b" in text or "\x0c" in text or "  " in text or "\n " in text or " \n" in text or "\n\n" in text:
            return re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of every text."""
        out: list[bytes] = []
        get = self.pieces.__getitem__
        for i in range(0, len(texts), TEXTS):
            some = texts[i : i + TEXTS]
            cut = [None if RARE_SPACE.search(t) else self.cut(t) for t in some]
            found = [None if c is None else list(map(get, c)) for c in cut]
            fresh = self.pieces.learn()
            for text, asked, parts in zip(some, cut, found):
                if parts is None:
                    out.append(self.pieces.ask(text))
                    continue
                at = -1
                for _ in range(parts.count(None)):
                    at = parts.index(None, at + 1)
                    parts[at] = fresh[asked[at]]
                out.append(b"".join(parts))
        return out
