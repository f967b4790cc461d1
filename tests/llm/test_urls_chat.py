"""URL rules and chat windows against plain Python."""
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from geoweft.llm import chat, queries, url_filter

from .conftest import prose

URLS = [
    None, "", "no scheme", "http://", "https://A.Example.ORG/es/x?y#z", "ftp://example.org?/es/", "x://org/", "x://org", "http://notorg/", "http://sub.com/fr/1",
    "http://COM/de/", "http://com/de", "http://example.org/en/12#a", "http://example.org/en/2", "a://b://c.org/", "http://ÉCOLE.org/Ü", "http://a.b.c.com/de/\nx",
    "http://org:80/", "http://.org/", "http://net/", "http://x.org//", "http://example.org/es",
]


def plain(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(r), r, v) for r, v in rules if ("." + host).endswith("." + r.split("/")[0]) and host and path.startswith(r[r.index("/"):])]
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else default


@pytest.mark.parametrize("most", [url_filter.MOST_BYTES, 20])
def test_rules_equal_plain_matching(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "MOST_BYTES", most)  # the small one splits the list over cascades
    r = random.Random(1)
    hosts = ["a.org", "b.a.org", "org", "x.com", "y.x.com", "com"]
    more = [(f"{h}/{p}", r.choice(["allow", "block"])) for h in hosts for p in ("", "q/", "q/w") if r.random() < 0.8]
    urls = URLS + [f"http://{r.choice(['', 'z.'])}{h}/{p}" for h in hosts for p in ("", "q", "q/", "q/w", "q/wx", "e")]
    for rules in (queries.URL_RULES, more, []):
        df = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)] + [(0, None, "c"), (None, urls[4], "c")], "page_id long, url string, rule string")
        listed = spark.createDataFrame(rules, "rule string, verdict string")
        got = Counter((x.page_id, x.host, x.path, x.rule, x.verdict) for x in url_filter.filter_urls(df, listed).collect())
        want = Counter((i, *plain(u, rules)) for i, u in [*enumerate(urls), (0, None), (None, urls[4])])
        assert got == want
    assert url_filter.filter_urls(df.limit(0), listed).count() == 0


def test_a_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(30_000).selectExpr("CAST(id AS STRING) AS key")
    universe = keys.select("key", *url_filter._hashed("key"))
    levels = url_filter.cascade(universe.filter("CAST(key AS INT) % 11 = 3"), universe)
    rows = universe.collect()
    hashes = np.array([[r.h1 & (2**64 - 1), r.h2 & (2**64 - 1)] for r in rows], np.uint64)
    assert len(levels) > 2
    assert [int(r.key) % 11 == 3 for r in rows] == url_filter.listed(hashes, levels).tolist()


def conversations():
    r = random.Random(2)
    rows = []
    for c in range(12):
        turns = r.randint(1, 30)
        for t in range(turns):
            role = "system" if t == 0 and c % 2 else ["user", "assistant"][t % 2]
            rows.append((c, t, role, prose(100 * c + t, r.choice([1, 5, 60, 300]))))
    rows += [(50, t, "assistant" if t % 2 else "user", f"turn {t} ### x </turn> \\ \\\\") for t in range(3000)]  # a hot conversation
    rows += [(55, t, ["system", "user", "assistant"][t and 1 + t % 2], prose(t, 40 if t else 3000)) for t in range(60)]  # a system turn beyond the budget
    rows += [(60, 0, "system", prose(9, 900)), (60, 1, "user", None), (60, 2, "assistant", "ok"), (None, 1, None, "a: b"), (None, 0, "ro: le\\", "### user: </turn>\n")]
    return rows + [(70, 1, "assistant", "same"), (70, 1, "assistant", "same"), (70, None, "user", ""), (80, 0, "assistant", prose(3, 2000)), (80, 1, "system", "late")]


def test_windows(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn int, role string, text string, window string").repartition(4)
    made = chat.windows(df)
    got = {}
    out = [r.asDict(recursive=True) for r in made.collect()]
    for r in sorted(out, key=lambda r: (str(r["conv_id"]), r["window"])):
        turns, loss = got.setdefault(r["conv_id"], ([], []))
        new = chat.parsed(r["text"])
        assert sum(len(chat.unescaped(r["text"][s["start"]:s["end"]])) for s in r["loss"]) == sum(len(t) for role, t in new[r["repeated"]:] if role == "assistant")
        turns += new[r["repeated"]:]
        loss += [chat.unescaped(r["text"][s["start"]:s["end"]]) for s in r["loss"]]
        own = len(new) - r["repeated"]
        lengths = [len(re.findall(chat.TOKEN, text, re.ASCII)) + 1 for _, text in new]
        assert r["tokens"] == sum(lengths)
        if r["tokens"] > chat.BUDGET:  # a single new turn, without history
            assert own == 1 and r["repeated"] <= 1 and lengths[-1] > chat.BUDGET - chat.SYSTEM, r
        if r["repeated"] and new[0][0] == "system":
            assert lengths[0] <= chat.SYSTEM
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    for c, turns in by.items():
        want = [(role, text) for *_, role, text in sorted(turns)]
        assert got[c][0] == want, c
        assert got[c][1] == [t for role, t in want if role == "assistant"]
    # history and system turn are repeated
    assert all(r["repeated"] for r in out if r["window"] and r["conv_id"] == 50)
    assert all(chat.parsed(r["text"])[0][0] == "system" for r in out if r["conv_id"] in (1, 3, 5, 60))
    # a long system turn doesn't crowd out the new ones
    rest = sum(len(re.findall(chat.TOKEN, text, re.ASCII)) + 1 for c, t, _, text in rows if c == 55 and t)
    cell = (chat.BUDGET - chat.HISTORY - chat.SYSTEM) // 2
    assert sum(r["conv_id"] == 55 for r in out) <= rest // cell + 3  # its cells, cut at both ends, and the system turn's own
    assert chat.read_back(chat.windows(df.limit(0))).count() == 0
    with pytest.raises(ValueError, match="nothing for new turns"):
        chat.windows(df, budget=200)


def test_digests_of_conversations(spark, tmp_path):
    rows = conversations()
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # conversations go on from batch to batch
    try:
        out = queries.QUERIES["op10_chat"](spark, str(tmp_path))
        got = {r.conv_id: r for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # only the pieces of a window are gathered in a row, never the windows of a conversation
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(piece" in plan and "collect_list(struct(window" not in plan
    by = {-7: [(True, 0, "user", r"\### Assistant: </turn> ok"), (True, 1, "assistant", r"\### Assistant: </turn> ok")]}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        whole = "".join(f"{role}\n{text}\n" for *_, role, text in sorted(turns))
        loss = "".join(text for *_, role, text in sorted(turns) if role == "assistant")
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in (whole, loss)]
        assert [got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256] == [len(turns), digests[0], len(loss), digests[1]], c


def test_escaping_is_reversible():
    for text in ["", "\\", "\\\\### </turn>", "### ### ", "a\\### b", "</turn></turn>", "\\### Assistant: </turn> ok", "<", "</turn", ":"]:
        assert chat.unescaped(chat.escaped(text)) == text
        assert chat.parsed(f"### user: {chat.escaped(text)}</turn>\n### a: b</turn>\n") == [("user", text), ("a", "b")]
