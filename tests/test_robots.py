"""Robots rules against a plain matcher."""

import random
import re

from pagemill.operators import captures


def decided(path, rules):
    best = None
    for kind, value in rules:
        if re.search(r"[*$]", value):
            end = value.endswith("$")
            pattern = ".*".join(re.escape(x) for x in value.rstrip("$").split("*") ) if end else ".*".join(map(re.escape, value.split("*")))
            hit = re.match(pattern + ("$" if end else ""), path)
        else:
            hit = value != "" and path.startswith(value)
        if hit:
            best = max(best or (0, False), (len(value), kind == "allow"))
    return "restricted" if best and not best[1] else "allowed"


def test_many_rules_and_addresses(spark):
    draw = random.Random(7)
    part = lambda: draw.choice(["a", "b", "cc", "d.html", "x"])
    hosts, pages, want = [], [], {}
    for h in range(6):
        rules = [(draw.choice(["allow", "disallow"]), "/" + "/".join(part() for _ in range(draw.randint(0, 3)))) for _ in range(40)]
        rules += [("disallow", "/*.html$"), ("allow", "/cc/*/x"), ("disallow", "")]
        body = "User-agent: *\n" + "\n".join(f"{k}: {v}" for k, v in rules) + "\nCrawl-delay: 3"
        hosts.append((f"h{h}.org", 200, body))
        for i in range(150):
            path = "/" + "/".join(part() for _ in range(draw.randint(0, 4)))
            pages.append((h * 1000 + i, f"https://h{h}.org{path}"))
            want[h * 1000 + i] = (decided(path, [r for r in rules if r[1]]), 3.0)
    hosts += [("gone.org", 404, ""), ("broken.org", 503, ""), ("blank.org", 200, None)]
    pages += [(9000, "https://gone.org/x"), (9001, "https://broken.org/x"), (9002, "https://blank.org/"), (9003, "https://none.org/"), (9003, "https://none.org/")]
    want |= {9000: ("allowed", None), 9001: ("unknown", None), 9002: ("unknown", None), 9003: ("unknown", None)}
    df = spark.createDataFrame(pages, "page_id int, url string")
    rows = captures.robots_filter(df, spark.createDataFrame(hosts, "host string, status int, body string")).collect()
    assert len(rows) == len(pages)
    assert {r.page_id: (r.robots_state, r.crawl_delay) for r in rows} == want
