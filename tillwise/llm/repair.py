"""Repair of conversation structure by a rank-convergence parallel Viterbi.

A conversation's rows, in order, are edited at least cost until the initials
of their roles read ``(s?(ua)+)?``: keep a row (0), change its role to user
or assistant (1), delete it (2; a must for blank and duplicate rows), insert
an empty row (5); a truncated row that stays costs 5 more.  Among the
cheapest edit sequences the one whose initials (D, I, K, R) are ASCII-least
is taken.

The costs of what remains, one per state of the pattern, run backward along
the rows.  Rows lie in range chunks of (conversation, order), so a
conversation that holds a third of all rows spans many chunks:

* every chunk starts from speculative cost vectors: one guess, whose vectors
  are stored row by row, and all the vectors that can occur, which merge as
  soon as they differ by constants only;
* the chunks' ends are stitched (one short row per chunk), and a fix-up pass
  reruns each chunk from its true vector until it meets the stored ones but
  for a constant;
* the stitched costs drive the tracing: each chunk is traced from every
  state, and the chunks' traces are chained.

Row vectors are kept with their least entry at 0; only ``len(VECTORS)`` of
them exist, so a stored vector is one byte and a step one table lookup.
A conversation inside one chunk needs none of the stitching.

Defined results for odd input: a null role counts as one space and a null
text as empty; a role of another initial (the empty role too) must be
changed or deleted; null ids form one conversation; rows of one turn are
ordered by role, then by a digest of the text (equal rows are
interchangeable); null turns come first; an empty table gives empty results.
A conversation's audit is one value, so it must fit into memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.plans.lineage import cut_lineage
from tillwise.plans.running import assign_range_chunks

# --- fixed values: costs and the pattern ---------------------------------------
RETAIN, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLANK_TEXT, LAST_MARK = "[^\\x20\\x09-\\x0D]", "[.!?][\\x20\\x09-\\x0D]*\\z"
SYMBOLS = "sua"                    # initials; any other is symbol 3
FINE, CUT_OFF, BLANK, REPEATED = range(4)
START, AFTER_S, AFTER_U, AFTER_A = range(4)
AFTER = {(0, START): AFTER_S, (1, START): AFTER_U, (1, AFTER_S): AFTER_U, (1, AFTER_A): AFTER_U,
         (2, AFTER_U): AFTER_A}
#: The row that may be inserted or made by a change of role in each state.
ADDED = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U, AFTER_U: AFTER_A}
ROLE = {AFTER_U: "user", AFTER_A: "assistant"}
ENDING = ("", "II", "I", "")       # edits after the last row, by state
FIRST_CODE = 65                    # codes are the letters A to P: 4 * symbol + fault
GUESS = 0


def _row_costs(code: int, later: tuple) -> list[dict[str, int]]:
    """Cost of each edit of the row in every state, with what follows."""
    symbol, fault = divmod(code, 4)
    stay = TRUNCATED if fault == CUT_OFF else 0
    costs = []
    for state in range(4):
        cost = {"D": DELETE + later[state]}
        if fault in (FINE, CUT_OFF):
            if (symbol, state) in AFTER:
                cost["K"] = RETAIN + stay + later[AFTER[symbol, state]]
            cost["R"] = REROLE + stay + later[ADDED[state]]
        costs.append(cost)
    return costs


def _with_inserts(costs: list[dict[str, int]]) -> list[int]:
    least = [min(c.values()) for c in costs]
    for _ in range(2):
        least = [min(x, INSERT + least[ADDED[s]]) for s, x in enumerate(least)]
    return least


def _tables():
    """All vectors that can occur, and the step and trace tables over them."""
    vectors, step, add, trace = [tuple(INSERT * len(e) for e in ENDING)], [], [], []
    number = {vectors[GUESS]: GUESS}
    at = 0
    while at < len(vectors):
        later, steps, adds, traces = vectors[at], [], [], []
        for code in range(16):
            costs = _row_costs(code, later)
            least = _with_inserts(costs)
            low = min(least)
            vector = tuple(x - low for x in least)
            if vector not in number:
                number[vector] = len(vectors)
                vectors.append(vector)
            steps.append(number[vector])
            adds.append(low)
            traces.append([_edits(code, costs, least, state) for state in range(4)])
        step.append(steps)
        add.append(adds)
        trace.append(traces)
        at += 1
    return vectors, np.array(step, np.uint8), np.array(add, np.int64), trace


def _edits(code: int, costs: list[dict[str, int]], least: list[int], state: int) -> tuple[str, int]:
    """The least letters from ``state`` over one row, and the state after."""
    letters = ""
    while True:
        cost = costs[state] | {"I": INSERT + least[ADDED[state]]}
        edit = min(e for e, c in cost.items() if c == least[state])
        letters += edit
        if edit == "D":
            return letters, state
        state = AFTER[code // 4, state] if edit == "K" else ADDED[state]
        if edit != "I":
            return letters, state


VECTORS, STEP, ADD, TRACE = _tables()
_STEP, _ADD = STEP.tolist(), ADD.tolist()


def codes_of(codes: str) -> np.ndarray:
    return np.frombuffer(codes.encode("ascii"), np.uint8) - FIRST_CODE


def backward(codes: np.ndarray, vector: int, stored: bytearray | None = None) -> tuple[bytearray, int]:
    """Numbers of the vectors after each row (from ``vector`` behind the last
    one) with the one before the first row in front, and the constant that
    they leave out.  With ``stored`` vectors of an earlier pass, the run stops
    where it meets them: from there on they differ by a constant only."""
    out = bytearray(len(codes) + 1) if stored is None else bytearray(stored)
    total, rows = 0, codes.tolist()
    out[len(codes)] = vector
    for i in range(len(rows) - 1, -1, -1):
        total += _ADD[vector][rows[i]]
        vector = _STEP[vector][rows[i]]
        if stored is not None and stored[i] == vector:
            break
        out[i] = vector
    return out, total


def forward(codes: np.ndarray, vectors: bytes, state: int) -> tuple[str, int]:
    """The edits of the rows from ``state`` on, and the state behind them."""
    letters = []
    for code, vector in zip(codes.tolist(), vectors[1:]):
        edits, state = TRACE[vector][code][state]
        letters.append(edits)
    return "".join(letters), state


def whole(codes: str) -> tuple[str, int]:
    """Audit and cost of a whole conversation."""
    rows = codes_of(codes)
    vectors, total = backward(rows, GUESS)
    audit, state = forward(rows, bytes(vectors), START)
    return audit + ENDING[state], total + VECTORS[vectors[0]][START]


def speculate(codes: np.ndarray) -> tuple[bytes, list[int], list[int]]:
    """Vectors stored from the guess; for every vector behind the chunk, the
    one before it and the constant."""
    stored, _ = backward(codes, GUESS)
    ends, totals = np.arange(len(VECTORS)), np.zeros(len(VECTORS), dtype=np.int64)
    for i in range(len(codes) - 1, -1, -1):
        totals += ADD[ends, codes[i]]
        ends = STEP[ends, codes[i]]
        if (ends == ends[0]).all():
            rest, more = backward(codes[:i], int(ends[0]))
            ends, totals = np.full(len(VECTORS), rest[0]), totals + more
            break
    return bytes(stored), ends.tolist(), totals.tolist()


# -- rows, codes and segments ----------------------------------------------------
def _rows(turns: DataFrame) -> DataFrame:
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.md5(text).alias("digest"))


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def _code() -> Column:
    """Symbol and fault of a row; repeated rows are told later."""
    initial = F.substring("role", 1, 1)
    symbol = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(~F.col("text").rlike(BLANK_TEXT), BLANK).when(~F.col("text").rlike(LAST_MARK), CUT_OFF).otherwise(FINE)
    return (symbol * 4 + fault).cast("int")


def _segments(conv_type: pa.DataType):
    """Runs of rows of one conversation within a chunk: their codes, with
    rows seen earlier in the run marked, and of a conversation that goes over
    several chunks the keys of its other rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, codes, seen, chunk, split, keys = (), bytearray(), set(), None, False, []
        done: list[tuple] = []

        def close() -> None:
            if now:
                done.append((now[0], chunk, codes.decode("ascii"), split, list(keys) if split else None))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done))
            done.clear()
            kinds = [conv_type, pa.int32(), pa.string(), pa.bool_(), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                              names=["conv_id", "chunk", "codes", "split", "keys"])

        for batch in batches:
            for conv, code, key, part, over in zip(*(batch.column(c).to_pylist()
                                                     for c in ("conv_id", "code", "key", "_rchunk", "split"))):
                if now != (conv,):
                    close()
                    now, codes, seen, chunk, split, keys = (conv,), bytearray(), set(), part, over, []
                if code % 4 != BLANK:
                    if key in seen:
                        code += REPEATED - code % 4
                    else:
                        seen.add(key)
                        if split:
                            keys.append(key)
                codes.append(FIRST_CODE + code)
            if len(done) >= 5000:
                yield flush()
        close()
        if done:
            yield flush()
    return run


def segments(turns: DataFrame) -> DataFrame:
    """``conv_id, chunk, codes, split``: one row per conversation and chunk."""
    from pyspark.sql.pandas.types import to_arrow_type
    kind = turns.schema["conv_id"].dataType
    rows = _rows(turns).select("conv_id", "turn", "role", "digest", _code().alias("code"),
                               F.unhex(F.md5(F.concat("role", F.lit("\0"), "digest"))).alias("key"),
                               F.monotonically_increasing_id().alias("_salt"))
    order = [*_order(), F.col("_salt")]
    rows = assign_range_chunks(rows, "conv_id", order)
    # a conversation over several chunks is the first or the last of each of them
    ends = rows.groupBy("_rchunk").agg(F.min(F.struct("conv_id")).alias("a"), F.max(F.struct("conv_id")).alias("b"))
    over = ends.select("_rchunk", F.explode(F.array("a", "b")).alias("s")).groupBy("s.conv_id").agg(
        F.min("_rchunk").alias("_lo"), F.max("_rchunk").alias("_hi")).filter("_lo < _hi").select(
        F.col("conv_id").alias("_split"), F.lit(True).alias("_over"))
    # at most one such conversation per border of two chunks
    told = rows.join(F.broadcast(over), F.col("conv_id").eqNullSafe(F.col("_split")), "left").select(
        "conv_id", *[c for c in ("turn", "role", "digest", "_salt", "code", "key", "_rchunk")],
        F.coalesce("_over", F.lit(False)).alias("split"))
    return told.sortWithinPartitions(F.col("conv_id").asc(), *order).select(
        "conv_id", "code", "key", "_rchunk", "split").mapInArrow(
        _segments(to_arrow_type(kind)), f"conv_id {kind.simpleString()}, chunk int, codes string, split boolean, "
                                        "keys array<binary>")


def _mark_repeated(parts: DataFrame) -> DataFrame:
    """Segments of split conversations, with rows seen in an earlier chunk
    marked: only the first row of each key in a chunk takes part."""
    keyed = parts.select("conv_id", "chunk", F.posexplode("keys").alias("nth", "key"))
    first = Window.partitionBy("conv_id", "key")  # at most one row per chunk
    again = keyed.withColumn("_first", F.min("chunk").over(first)).filter(F.col("chunk") > F.col("_first")).groupBy(
        F.col("conv_id").alias("_c"), F.col("chunk").alias("_k")).agg(F.collect_list("nth").alias("nths"))

    @F.pandas_udf("string")
    def mark(codes: pd.Series, nths: pd.Series) -> pd.Series:
        def one(text, which):
            if which is None:
                return text
            rows = codes_of(text).copy()
            own = np.flatnonzero(rows % 4 < BLANK)[np.asarray(which, dtype=np.int64)]
            rows[own] += (REPEATED - rows[own] % 4).astype(np.uint8)
            return (rows + FIRST_CODE).astype(np.uint8).tobytes().decode("ascii")
        return pd.Series([one(t, w) for t, w in zip(codes, nths)], dtype=object)

    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("chunk") == F.col("_k"))
    return parts.join(again, same, "left").select("conv_id", "chunk", mark("codes", "nths").alias("codes"))


# -- the parallel passes over split conversations ----------------------------------
def _stitch_back(group: pd.DataFrame) -> pd.DataFrame:
    """From the last chunk to the first: the true vector behind each chunk,
    and on the first chunk the conversation's cost."""
    group = group.sort_values("chunk", ascending=False)
    vector, total, behind = GUESS, 0, []
    for ends, totals in zip(group["ends"], group["totals"]):
        behind.append(vector)
        vector, total = int(ends[vector]), total + int(totals[vector])
    group = group.assign(behind=behind, cost=total + VECTORS[vector][START])
    return group[["conv_id", "chunk", "behind", "cost"]]


def _stitch_forth(group: pd.DataFrame) -> pd.DataFrame:
    """From the first chunk to the last: the state that each chunk starts in."""
    group = group.sort_values("chunk")
    state, starts = START, []
    for states in group["states"]:
        starts.append(state)
        state = int(states[state])
    ending = [""] * (len(group) - 1) + [ENDING[state]]
    return group.assign(start=starts, ending=ending)[["conv_id", "chunk", "start", "ending"]]


def _speculate(codes: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([speculate(codes_of(c)) for c in codes], columns=["vectors", "ends", "totals"])


def _fix_up(codes: pd.Series, vectors: pd.Series, behind: pd.Series) -> pd.DataFrame:
    out = []
    for text, stored, vector in zip(codes, vectors, behind):
        rows = codes_of(text)
        true, _ = backward(rows, int(vector), bytearray(stored))
        traced = [forward(rows, bytes(true), state) for state in range(4)]
        out.append(([a for a, _ in traced], [s for _, s in traced]))
    return pd.DataFrame(out, columns=["audits", "states"])


def _beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join of two tables with one row per (conversation, chunk)."""
    right = right.withColumnsRenamed({"conv_id": "_c", "chunk": "_k"})
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("chunk") == F.col("_k"))
    return left.join(right, same).drop("_c", "_k")


def _over_chunks(parts: DataFrame) -> DataFrame:
    kind = parts.schema["conv_id"].dataType.simpleString()
    guess = F.pandas_udf(_speculate, "struct<vectors: binary, ends: array<int>, totals: array<bigint>>")
    fix_up = F.pandas_udf(_fix_up, "struct<audits: array<string>, states: array<int>>")
    guessed = cut_lineage(_mark_repeated(parts).select("*", guess("codes").alias("_s")).select(
        "conv_id", "chunk", "codes", "_s.*"))
    behind = guessed.select("conv_id", "chunk", "ends", "totals").groupBy("conv_id").applyInPandas(
        _stitch_back, f"conv_id {kind}, chunk int, behind int, cost bigint")
    fixed = cut_lineage(_beside(guessed.select("conv_id", "chunk", "codes", "vectors"), behind).select(
        "conv_id", "chunk", "codes", "cost", fix_up("codes", "vectors", "behind").alias("_f")).select(
        "conv_id", "chunk", "codes", "cost", "_f.*"))
    starts = fixed.select("conv_id", "chunk", "states").groupBy("conv_id").applyInPandas(
        _stitch_forth, f"conv_id {kind}, chunk int, start int, ending string")
    piece = F.struct("chunk", "codes", F.concat(F.get("audits", F.col("start")), "ending").alias("audit"))
    return _beside(fixed, starts).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(piece)).alias("_p"), F.max("cost").alias("cost")).select(
        "conv_id", F.array_join("_p.codes", "").alias("codes"), F.array_join("_p.audit", "").alias("audit"), "cost")


def _whole(codes: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([whole(c) for c in codes], columns=["audit", "cost"])


def audits(turns: DataFrame) -> DataFrame:
    """``conv_id, codes, audit, cost`` of every conversation that has rows
    (``conv_id, turn, role, text``).  ``codes`` has a letter per row
    (:func:`row_faults` counts them), ``audit`` the initials of the edits."""
    parts = cut_lineage(segments(turns))
    alone = F.pandas_udf(_whole, "struct<audit: string, cost: bigint>")
    inside = parts.filter("not split").select("conv_id", "codes", alone("codes").alias("_w")).select(
        "conv_id", "codes", "_w.*")
    return inside.unionByName(_over_chunks(parts.filter("split").drop("split")))


def row_faults(codes: Column) -> dict[str, Column]:
    """Counts by fault, and of adjacent rows whose initials do not fit."""
    def letters(fault: int) -> str:
        return "".join(chr(FIRST_CODE + 4 * s + fault) for s in range(4))

    def count(fault: int) -> Column:
        return (F.length(codes) - F.length(F.translate(codes, letters(fault), ""))).cast("bigint")

    initials = F.translate(codes, "ABCDEFGHIJKLMNOP", "ssssuuuuaaaaxxxx")
    fitting = F.size(F.regexp_extract_all(initials, F.lit("(?=su|ua|au)"), F.lit(0)))
    return {"blank": count(BLANK), "duplicate": count(REPEATED), "truncated": count(CUT_OFF),
            "illegal": (F.greatest(F.length(codes) - 1, F.lit(0)) - fitting).cast("bigint")}


# -- the repaired rows -----------------------------------------------------------
def _apply(conv_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, audit, at, state, place = None, "", 0, START, 0
        out: list[tuple] = []

        def add(edit: str, role: str, text: str) -> None:
            nonlocal place
            out.append((now, place, edit, role, text))
            place += 1

        def inserts() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                state = ADDED[state]
                add("I", ROLE[state], "")
                at += 1

        for batch in batches:
            for conv, kind, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text"))):
                if kind == 0:  # the conversation's audit comes first
                    inserts()
                    now, audit, at, state, place = conv, text, 0, START, 0
                    continue
                inserts()
                edit = audit[at]
                at += 1
                if edit == "K":
                    state = AFTER[SYMBOLS.index(role[0]), state]
                elif edit == "R":
                    state = ADDED[state]
                    role = ROLE[state]
                if edit != "D":
                    add(edit, role, text)
            if out:
                yield _repaired_batch(out, conv_type)
        inserts()
        if out:
            yield _repaired_batch(out, conv_type)
    return run


def _repaired_batch(out: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
    columns, kinds = list(zip(*out)), [conv_type, pa.int64(), pa.string(), pa.string(), pa.string()]
    out.clear()
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                      names=["conv_id", "place", "edit", "role", "text"])


def repaired(turns: DataFrame, audited: DataFrame) -> DataFrame:
    """The rows that the edits of :func:`audits` leave: ``conv_id, place``
    (from 0), ``edit`` (K, R or I), ``role, text``.  A conversation's rows come
    one after another from one task, which streams them."""
    from pyspark.sql.pandas.types import to_arrow_type
    kind = turns.schema["conv_id"].dataType
    rows = _rows(turns).withColumn("kind", F.lit(1))
    marks = audited.select("conv_id", F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"),
                           F.lit("").alias("role"), F.col("audit").alias("text"), F.lit("").alias("digest"),
                           F.lit(0).alias("kind"))
    return rows.unionByName(marks).repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc(), "kind", *_order()).select("conv_id", "kind", "role", "text").mapInArrow(
        _apply(to_arrow_type(kind)), f"conv_id {kind.simpleString()}, place bigint, edit string, role string, text string")


def digests(rows: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` over ``role:text`` of each conversation's
    rows, newline-joined; ``rows`` as :func:`repaired` gives them.  SHA-256 is
    a chain, so one task streams a conversation; it holds a batch at a time."""
    import hashlib

    from pyspark.sql.pandas.types import to_arrow_type
    kind = rows.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done = []
            for conv, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text"))):
                if place == 0:
                    if digest is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = conv, hashlib.sha256()
                digest.update(f"\n{role}:{text}".encode() if place else f"{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], to_arrow_type(kind)),
                                                  pa.array([d for _, d in done], pa.string())],
                                                 names=["conv_id", "repaired_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], to_arrow_type(kind)), pa.array([digest.hexdigest()])],
                                             names=["conv_id", "repaired_sha256"])

    return rows.mapInArrow(run, f"conv_id {kind.simpleString()}, repaired_sha256 string")


def turn_gaps(turns: DataFrame) -> DataFrame:
    """``conv_id, gaps``: turns missing between a conversation's first and
    last one (null turns do not count)."""
    return turns.select("conv_id", "turn").distinct().groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint").alias("gaps"))
