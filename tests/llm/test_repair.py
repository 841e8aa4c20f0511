import hashlib
import heapq
import random
import re

import numpy as np

from tests.conftest import SF_MID
from tests.oracle_compare import duck
from tillwise.llm import queries
from tillwise.llm import repair as R

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def cheapest(rows):
    """(cost, least audit, repaired rows) by search over all edit sequences;
    ``rows``: (role, text) in order."""
    faults, seen = [], set()
    for role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else
                      "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, least, found = [(0, "", 0, "", ())], None, []
    while heap:
        cost, audit, at, initials, kept = heapq.heappop(heap)
        if least is not None and cost > least:
            break
        if not re.fullmatch(r"s?(ua)*u?", initials) or cost > 2 * len(rows):  # all may be deleted
            continue
        if at == len(rows) and re.fullmatch(r"(s?(ua)+)?", initials):
            least = cost
            found.append((audit, kept))
            continue
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 5, audit + "I", at, initials + role[0], (*kept, (role, ""))))
        if at < len(rows):
            (role, text), stay = rows[at], 5 * (faults[at] == "truncated")
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, initials, kept))
            if faults[at] not in ("blank", "duplicate"):
                heapq.heappush(heap, (cost + stay, audit + "K", at + 1, initials + (role[:1] or "?"), (*kept, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 1 + stay, audit + "R", at + 1, initials + new[0], (*kept, (new, text))))
    audit, kept = min(found)
    misfits = sum((a[:1] + b[:1]) not in ("su", "ua", "au") for (a, _), (b, _) in zip(rows, rows[1:]))
    return {"cost": least, "audit": audit, "rows": list(kept), "illegal": misfits} | {
        f: faults.count(f) for f in ("blank", "duplicate", "truncated")}


def random_conversation(rng, n):
    roles = rng.choices(["user", "assistant", "system", "tool", ""], [5, 5, 2, 1, 0.3], k=n)
    texts = rng.choices(["", " \t", "a.", "b!", "cut", "d?", "e. \n"], [1, 1, 6, 6, 3, 6, 3], k=n)
    return [(r, t if rng.random() < 0.3 else t and t.strip() and f"{i}{t}") for i, (r, t) in enumerate(zip(roles, texts))]


def told(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    audited = R.audits(frame)
    out = {r.conv_id: r.asDict() for r in audited.select(
        "conv_id", "audit", "cost", *[c.alias(n) for n, c in R.row_faults(audited["codes"]).items()]).collect()}
    lines = {}
    for r in R.repaired(frame, audited).collect():
        lines.setdefault(r.conv_id, {})[r.place] = (r.role, r.text)
    for conv in out:
        got = lines.get(conv, {})
        out[conv]["rows"] = [got[i] for i in range(len(got))]
    hashed = {r.conv_id: r.repaired_sha256 for r in R.digests(R.repaired(frame, audited)).collect()}
    for conv, got in out.items():
        plain = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in got["rows"]).encode()).hexdigest()
        assert hashed.get(conv, hashlib.sha256(b"").hexdigest()) == plain
    return out


def test_query_equals_oracle(spark):
    query, sql = queries.QUERIES["op12_conversation_repair"]
    got, want = query(spark, SF_MID), duck(SF_MID).sql(sql)
    rows = sorted(map(tuple, got.select(*want.columns).collect()))
    assert rows and rows == sorted(want.fetchall())


def test_every_edit_sequence_of_small_conversations(spark):
    rng = random.Random(12)
    conversations = {i: random_conversation(rng, rng.randrange(1, 7)) for i in range(250)}
    rows = [(c, i, role, text) for c, found in conversations.items() for i, (role, text) in enumerate(found)]
    rng.shuffle(rows)
    got = told(spark, rows)
    assert len(got) == len(conversations)
    for c, found in conversations.items():
        want = cheapest(found)
        assert {k: got[c][k] for k in want} == want, (c, found)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, None, None, "x."), (1, 3, "user", "a."), (1, 3, "user", "a."), (1, 4, "assistant", "b."),
            (None, 0, "user", "q?"), (None, 1, "assistant", "r."), (2, 0, "user", "w " * 300_000 + "."),
            (2, 1, "assistant", "z."), (3, 0, "", ""), (4, 5, "system", "s.\u0085")]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as chunk", "2 as codes", "3 as place", "4 as _rchunk")
    got = {r.conv_id: (r.audit, r.cost) for r in R.audits(frame).collect()}
    assert got == {1: ("DDKDK", 6), None: ("KK", 0), 2: ("KK", 0), 3: ("D", 2), 4: ("D", 2)}
    gaps = {r.conv_id: r.gaps for r in R.turn_gaps(frame).collect()}
    assert gaps == {1: 0, None: 0, 2: 0, 3: 0, 4: 0}
    none = frame.limit(0)
    assert R.audits(none).count() == 0
    assert R.digests(R.repaired(none, R.audits(none))).count() == 0


def test_one_conversation_over_many_chunks(spark):
    """Split over chunks, all ties and faults included, the outcome is that of
    one run from end to end; rows repeated in other chunks are found."""
    rng = random.Random(5)
    rows, old = [], spark.conf.get("spark.sql.shuffle.partitions")
    for c, repeats in ((7, 0.02), (9, 0.9), (11, 1.0)):
        for i in range(3000):
            role = rng.choice(["user", "assistant", "assistant", "system"])
            text = rng.choice(["same.", "again!"]) if rng.random() < repeats else f"{i} {rng.choice(['.', 'cut', '', ' '])}"
            rows.append((c, i, "user" if c == 11 else role, "same." if c == 11 else text))
    rows += [(i + 100, 0, "user", "a.") for i in range(50)]
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
        assert R.segments(frame).filter("split and conv_id = 7").count() > 3
        got = told(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for c in (7, 9, 11):
        codes, seen = "", set()
        for conv, _, role, text in rows:
            if conv == c:
                fault = (R.BLANK if not text.strip() else R.REPEATED if (role, text) in seen else
                         R.FINE if text.strip()[-1] in ".!?" else R.CUT_OFF)
                seen.add((role, text))
                codes += chr(R.FIRST_CODE + 4 * "sua".index(role[0]) + fault)
        assert (got[c]["audit"], got[c]["cost"]) == R.whole(codes)


def test_fix_up_meets_the_stored_vectors():
    rng = np.random.default_rng(1)
    for _ in range(50):
        codes = rng.choice(16, size=200, p=[.05, .03, .03, .03, .2, .05, .03, .05, .2, .05, .03, .05, .05, .05, .05, .05])
        stored, ends, totals = R.speculate(codes)
        for vector in range(len(R.VECTORS)):
            true, total = R.backward(codes, vector)
            assert R.backward(codes, vector, bytearray(stored))[0] == true
            assert (ends[vector], totals[vector]) == (true[0], total)
