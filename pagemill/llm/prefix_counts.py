"""Exact token counts of every prefix of every text, by dynamic programming.

The token count of text[:k] for all k is stored once, in code points; how many tokens a
part from the start has, whether a text is over a limit and where to cut it for a budget
are then lookups, and nothing is encoded again.

In byte pair encoding the last token of a prefix decides all before it: an encoding is
right if each two neighbours are what encoding the two of them alone gives. So the last
token of a prefix is the one token that ends there and agrees with the last token of the
prefix before it, and its count is that prefix' count and one. A text is cut at ASCII
white space, where no token crosses; a word is worked out once and remembered.

The tokenizer is a .json file of the tokenizers library: BPE with word ends whose
pre-tokenizer drops white space; other files are refused. Its normalizer and
pre-tokenizer come from the library itself. Strings of special tokens inside a text are
one token each, and ordinary text where the prefix ends inside one.

Null and empty texts have no prefixes and count 0. Repeated rows are counted each; an
empty table gives no rows. Columns of docs that are called like an added column are
replaced. A text is worked on in slices of a million code points or so; only its counts
are held whole. In a word that is not in Unicode's composed form, prefixes that end
within a composed character are worked out singly from the piece before.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE = 1 << 20  # code points of a text worked on at once
BATCH = 1 << 21  # code points whose counts go to Spark at once
KEPT = 600_000  # words (and pieces of words) remembered, in each of two generations
KEPT_PAIRS = 400_000
KEPT_BEGUN = 300_000  # beginnings of words remembered, of at most BEGUN bytes
BEGUN = 7
WORDS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z")
SPACE = re.compile(r"[\x20\x09-\x0D]")
SPACE_CHARACTERS = " \t\n\x0b\x0c\r"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1
    bytes stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class PrefixEncoder:
    """Counts of prefixes by one tokenizer file; one for each worker process."""

    known: dict[str, PrefixEncoder] = {}

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, split = file["model"], file["pre_tokenizer"]
        self.end = model.get("end_of_word_suffix")
        drops = self.library.encode("a b", add_special_tokens=False).ids == self.library.encode("a \n b", add_special_tokens=False).ids
        if model["type"] != "BPE" or not self.end or not drops:
            raise ValueError(f"{path}: not byte pair encoding with word ends that drops white space")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.made = {a + b: (a, b, i) for i, (a, b) in enumerate(merges)}
        pattern = next(s["pattern"]["Regex"] for s in split["pretokenizers"] if s["type"] == "Split")
        for name, letters in ((r"[\p{L}]", "[A-Za-z]"), (r"[\p{N}]", "[0-9]"), (r"\p{L}", "A-Za-z"), (r"\p{N}", "0-9"), (r"\s", r"\x20\x09-\x0D")):
            pattern = pattern.replace(name, letters)
        self.ascii = re.compile(pattern)  # the pre-tokenizer's pattern on ASCII
        self.tails = {t[: -len(self.end)]: t for t in model["vocab"] if t.endswith(self.end)}
        self.inner = {t for t in model["vocab"] if not t.endswith(self.end)}
        self.longest = max(map(len, [*self.inner, *self.tails]))
        self.letters = byte_letters()
        self.special = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.agree: dict[tuple[str, str], bool] = {}
        self.rights: dict[str, list[tuple[str, int]]] = {}
        self.lefts: dict[str, list[tuple[str, int]]] = {}
        self.begun: dict[str, tuple[str, int, int]] = {}
        self.folded: dict[str, str] = {}
        self.pieces: dict[str, bytes] = {}
        self.pieces_before: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.seconds: set[str] = set()

    @classmethod
    def of(cls, path: str) -> PrefixEncoder:
        if path not in cls.known:
            cls.known[path] = cls(path)
        return cls.known[path]

    # ---- one piece of the pre-tokenizer

    def _spine(self, token: str, right: bool) -> list[tuple[str, int]]:
        """What stands at the right (left) end of a token while it is merged together, each
        with the rank of the merge that ends it."""
        known = self.rights if right else self.lefts
        if token not in known:
            out, rank = [(token, len(self.rank))], len(self.rank)
            part = token
            while part in self.made:
                *halves, rank = self.made[part]
                part = halves[right]
                out.append((part, rank))
            known[token] = out
        return known[token]

    def _neighbours(self, a: str, b: str) -> bool:
        """Whether merging the letters of a and b ends in a and b; b may end the word.

        Merges happen in the order of their ranks, equal ones from left to right. So the
        two stay apart unless something across the border can be merged before what is
        to the left of it, and not after what is to the right."""
        rank = self.rank
        known = True
        left = self._spine(b, False)
        for x, x_ends in self._spine(a, True):
            for y, y_ends in left:
                at = rank.get((x, y))
                if at is not None and at < x_ends and at <= y_ends:
                    known = False
        if len(self.agree) >= KEPT_PAIRS:
            self.agree.clear()
        self.agree[a, b] = known
        return known

    def _piece(self, piece: str) -> bytes:
        """Changes of the count, prefix by prefix, each taken as a whole piece."""
        found = self.pieces_before.get(piece)
        if found is None:
            counts = self._counts(piece)
            if len(piece) > 1 and piece[0] == "'" and piece[1:].isalpha():  # a contraction, apart while it is not whole
                counts = [self.total(piece[:k]) for k in range(1, len(piece))] + counts[-1:]
            found = self._changes(counts)
        if len(piece) <= 40:
            if len(self.pieces) >= KEPT:  # what is not met again in a generation is forgotten
                self.pieces_before, self.pieces = self.pieces, {}
            self.pieces[piece] = found
        return found

    @staticmethod
    def _changes(counts: list[int]) -> bytes:
        changes = array("h", map(sub, counts, [0, *counts]))
        if sys.byteorder == "big":
            changes.byteswap()
        return changes.tobytes()

    def _counts(self, piece: str) -> list[int]:
        if piece.isascii() and piece.isprintable():  # these bytes stand for themselves
            letters, ends = piece, None
        else:
            data = [c.encode() for c in piece]
            letters = "".join([self.letters[b] for d in data for b in d])
            ends = np.cumsum([len(d) for d in data]).tolist()
        inner, tails, agree, neighbours = self.inner, self.tails, self.agree, self._neighbours
        begun, longest = self.begun, self.longest
        # the last token and the count of what begins the word and does not end it; the count if it does
        last, count, whole = [""], [0], [0]
        for end in range(1, len(letters) + 1):
            if end <= BEGUN:
                known = begun.get(letters[:end])
                if known is not None:  # words begin alike
                    last.append(known[0])
                    count.append(known[1])
                    whole.append(known[2])
                    continue
            own = closed = None
            for start in range(end - longest if end > longest else 0, end):
                token = letters[start:end]
                if own is None and token in inner:
                    pair = (last[start], token)
                    right = agree.get(pair) if start else True
                    if right or (right is None and neighbours(*pair)):
                        own = token
                        last.append(token)
                        count.append(count[start] + 1)
                if closed is None and token in tails:
                    pair = (last[start], tails[token])
                    right = agree.get(pair) if start else True
                    if right or (right is None and neighbours(*pair)):
                        closed = token
                        whole.append(count[start] + 1)
                if own is not None and closed is not None:
                    break
            if end <= BEGUN:
                if len(begun) >= KEPT_BEGUN:
                    begun.clear()
                begun[letters[:end]] = (last[end], count[end], whole[end])
        return whole[1:] if ends is None else [whole[k] for k in ends]

    # ---- a word: what stands between ASCII white space

    def _split(self, body: str) -> list[tuple[int, int]]:
        if body.isascii():
            return [m.span() for m in self.ascii.finditer(body)]
        if body.isalpha() and max(body) < "\u0250":  # Latin letters alone
            return [(0, len(body))]
        return [place for _, place in self.library.pre_tokenizer.pre_tokenize_str(body)]

    def _normal(self, body: str) -> bytes:
        """Changes of the count over the prefixes of a normalized string."""
        get, at, parts = self.pieces.get, 0, []
        for start, end in self._split(body):
            if start > at:
                parts.append(bytes(2 * (start - at)))
            piece = body[start:end]
            parts.append(get(piece) or self._piece(piece))
            at = end
        parts.append(bytes(2 * (len(body) - at)))
        return b"".join(parts)

    def _run(self, body: str) -> list[int]:
        """Counts of every prefix of a normalized string, the empty one included."""
        return [0, *np.cumsum(np.frombuffer(self._normal(body), "<i2"), dtype=np.int64).tolist()]

    def total(self, body: str) -> int:
        return self._run(body)[-1]

    def _fold(self, body: str) -> list[str]:
        """What the normalizer makes of every character of a composed string."""
        if body.isascii():
            return list(body.lower())
        fold = self.folded
        for c in body:
            if c not in fold:
                fold[c] = c.lower() if c.isascii() else self.library.normalizer.normalize_str(c)
        return [fold[c] for c in body]

    def _ordinary(self, word: str) -> list[int]:
        """Counts of every prefix of a word without special tokens."""
        if unicodedata.is_normalized("NFC", word):
            folded = self._fold(word)
            counts = self._run("".join(folded))
            return [counts[k] for k in np.cumsum([len(f) for f in folded]).tolist()]
        groups = self._groups(word)
        whole = ["".join(self._fold(unicodedata.normalize("NFC", g))) for g in groups]
        body = "".join(whole)
        counts = self._run(body)
        starts = [s for s, _ in self._split(body)]
        out, at, seen = [], 0, 0
        for group, made in zip(groups, whole):
            while seen < len(starts) and starts[seen] < at:
                seen += 1
            back = starts[max(seen - 3, 0)] if starts else 0
            back = min(back, at)
            for k in range(1, len(group)):
                part = "".join(self._fold(unicodedata.normalize("NFC", group[:k])))
                out.append(counts[back] + self.total(body[back:at] + part))
            at += len(made)
            out.append(counts[at])
        return out

    def _groups(self, word: str) -> list[str]:
        """A word cut before every character that does not combine with what is before."""
        if not self.seconds:
            pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x80, 0x30000))
            self.seconds = {chr(int(p[1], 16)) for p in pairs if len(p) == 2 and p[0][0] != "<"}
            self.seconds.update(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]))  # Hangul vowels, finals
        groups: list[str] = []
        for c in word:
            first = unicodedata.normalize("NFD", c)[0]
            if groups and (unicodedata.combining(first) or first in self.seconds):
                groups[-1] += c
            else:
                groups.append(c)
        return groups

    def _word(self, word: str) -> list[int]:
        places = [(i, -len(s), s) for s in self.special if (i := word.find(s)) >= 0]
        if not places:
            return self._ordinary(word)
        at, _, special = min(places)
        # a special token counts from its last character on; before, it is ordinary text
        before = self._ordinary(word[: at + len(special) - 1])
        done = (before[at - 1] if at else 0) + 1
        rest = word[at + len(special) :]
        return before + [done] + ([done + c for c in self._word(rest)] if rest else [])

    def steps(self, word: str) -> bytes:
        """Changes of the count from prefix to prefix, 16-bit, of white space and a word."""
        found = self.older.get(word)
        if found is None:
            body = word.lstrip(SPACE_CHARACTERS)
            found = bytes(2 * (len(word) - len(body)))
            if body and not any(s in body for s in self.special):
                folded = [body.lower()] if body.isascii() else self._fold(body) if unicodedata.is_normalized("NFC", body) else [""]
                plain = "".join(folded)
                # one character for one: the changes are those of the normalized string
                found += self._normal(plain) if len(plain) == len(body) else self._changes(self._ordinary(body))
            elif body:
                found += self._changes(self._word(body))
        if len(word) <= 60:
            if len(self.words) >= KEPT:  # what is not met again in a generation is forgotten
                self.older, self.words = self.words, {}
            self.words[word] = found
        return found

    def counts(self, text: str) -> np.ndarray:
        """counts[k - 1] is the token count of text[:k]."""
        parts: list[np.ndarray] = []
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > SLICE:
                space = SPACE.search(text, at + SLICE)
                end = space.start() if space else end
            words = WORDS.findall(text, at, end)
            get = self.words.get
            steps = [get(w) or self.steps(w) for w in words]
            parts.append(np.frombuffer(b"".join(steps), "<i2"))
            at = end
        return np.cumsum(np.concatenate(parts), dtype=np.int32) if parts else np.zeros(0, np.int32)


def _batches(rows: Iterable[tuple], encode, budgets: list[int], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    carried, counts, fits = [], [], []

    def made() -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, counts)], dtype=np.int32)
        values = np.concatenate([np.zeros(0, np.int32), *counts])
        columns = [pa.array(c, f.type) for c, f in zip(zip(*carried), schema)]
        columns.append(pa.ListArray.from_arrays(ends, values))
        columns.append(pa.array(fits, pa.list_(pa.int32())))
        batch = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)
        carried.clear(), counts.clear(), fits.clear()
        return batch

    size = 0
    for *row, text in rows:
        own = encode(text or "")
        carried.append(row)
        counts.append(own)
        places = [np.flatnonzero(own <= b) for b in budgets]
        fits.append([int(p[-1]) + 1 if len(p) else 0 for p in places])
        size += len(own) + 50
        if size >= BATCH:
            yield made()
            size = 0
    if carried:
        yield made()


def prefix_counts(docs: DataFrame, tokenizer: str, budgets: Iterable[int] = (), text: str = "text") -> DataFrame:
    """docs without the text, and `prefix_tokens` (array: the token counts of its prefixes of
    1, 2, ... code points) and `fits` (for every budget the code points of the longest
    prefix of at most so many tokens). `tokenizer` is a path that is the same on every
    machine."""
    budgets = list(budgets)
    kept = [c for c in docs.columns if c not in (text, "prefix_tokens", "fits")]
    schema = T.StructType([docs.schema[c] for c in kept])
    schema = schema.add("prefix_tokens", T.ArrayType(T.IntegerType())).add("fits", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = PrefixEncoder.of(tokenizer).counts
        fields = None
        for batch in batches:
            if fields is None:
                lists = [pa.field(n, pa.list_(pa.int32())) for n in ("prefix_tokens", "fits")]
                own = [f.with_name(n) for f, n in zip(batch.schema, kept)]
                fields = pa.schema([*own, *lists])
            values = [c.to_pylist() for c in batch.columns[:-1]]
            texts = (t.as_py() for t in batch.column(len(values)))
            yield from _batches(zip(*values, texts), encode, budgets, fields)

    # plain names on the way in: a column may be called anything
    taken = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate([*kept, text])]
    return docs.select(*taken).mapInArrow(run, schema)


def n_tokens(prefix_tokens: Column) -> Column:
    """Tokens of the whole text."""
    return F.coalesce(F.try_element_at(prefix_tokens, F.lit(-1)), F.lit(0)).cast("bigint")


def tokens_before(prefix_tokens: Column, characters: Column) -> Column:
    """Tokens of the first so many code points; of the whole text if it is shorter."""
    at = F.least(characters, F.size(prefix_tokens))
    return F.when(at < 1, F.lit(0)).otherwise(F.get(prefix_tokens, at - 1)).cast("bigint")
