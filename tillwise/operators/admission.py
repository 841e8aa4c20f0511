"""B-3: sequential, all-or-nothing admission of a batch of carts.

Orders are admitted in time order; an accepted order lowers the stock seen
by every later order sharing a product.  Instead of replaying orders one by
one, each round bounds, for every undecided order line, the quantity of the
same product already taken by earlier orders:

* ``lower`` = sum of the quantities of earlier *accepted* lines,
* ``upper`` = that sum over earlier accepted *and undecided* lines.

An order is accepted when every line fits even at ``upper`` and rejected when
some line does not fit even at ``lower``.  Since lower <= truth <= upper the
decisions equal the sequential replay; the earliest undecided order always has
lower == upper, so every round decides at least one order (in practice a
large share).

What is left after a round is mostly small: orders that are linked through
products on which they still compete form components.  As soon as all open
lines are few they are replayed order by order in one task of bounded size;
before that, whenever a round has decided little, the components that a few
steps of label spreading close, and that are bounded too, are replayed side by
side, and only a larger one goes on in rounds.

A round is kept cheap: a line carries what the accepted lines before it took,
so a decided line leaves the work one round later, and the rounds read and
write the open lines only.  Lines are stored dealt by (product, chunk), where
the first round finds them: a hot product is spread over range chunks along
time, any other is one chunk, and only hot products need offsets.  A large batch is
decided in a fixed number of slices of time, each against what the earlier
ones took.  Rounds are tables below ``spark.checkpoint.dir``, removed at the end.
"""

from __future__ import annotations

import datetime as dt
import os

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from tillwise.operators import billing
from tillwise.plans.broadcast import met_by_shuffle
from tillwise.plans.lineage import cut_lineage, deal_out, drop_tables
from tillwise.plans.running import assign_range_chunks, chunked_running_sum, hot_keys, mark_cold, spanning_keys
from tillwise.session import checkpoint_root, path_exists, remove_path, scratch_path
from tillwise.sources import derived as D
from tillwise.sources import sinks
from tillwise.sources.tables import Tables, ntz

#: Open lines that one task replays; each component's bound, and that of all together.
REPLAY_LINES = 400_000
#: A round that decides a smaller share of the open lines is followed by a look
#: for components, with so many steps of label spreading.
SLOW_ROUND, SPREAD_STEPS = 0.05, 4
#: A batch of more lines than this is decided in slices of time, the earlier
#: first, as few of a short span's orders are still in doubt after a round; at most so many.
SLICE_LINES, MAX_SLICES = 1_000_000, 16
LINE_COLS = ["order_id", "product_id", "qty", "_cart", "order_date", "_rchunk", "supply"]
#: The products of at most so many open lines are broadcast (about 16 MB), so that accepted lines of others stay where they are.
OPEN_PRODUCTS = 250_000
DECISION_COLS = ["order_id", "decision", "reason", "failing_product_id", "available", "decided_round"]


def supply_per_line(lines: DataFrame, opening: DataFrame, restocks: DataFrame, hot: DataFrame,
                    root: str) -> tuple[DataFrame, dict, DataFrame | None]:
    """Opening stock plus every accepted restock at or before the order's
    time (restocks sort before sales at the same instant), how running
    sums find the keys that span chunks, and the (product, chunk) pairs of hot
    products, if any: about as many as there are hot products and chunks.  ``_rchunk``: the line's chunk along
    (product, order time, order); a ``hot`` product's are ranges, and any
    other product is one chunk, which one shuffle brings together.  Tables
    written below ``root``: the hot products' events and those that span
    chunks."""
    ev_lines = lines.select("order_id", "product_id", "qty", "_cart", "_slice", F.col("order_date").alias("_ts"),
                            F.lit(2).alias("_kind"), F.lit(0).alias("_add"))
    ev_rs = restocks.select(F.lit(None).cast("bigint").alias("order_id"), "product_id",
                            F.lit(0).alias("qty"), F.lit(0).cast("bigint").alias("_cart"), F.lit(0).alias("_slice"),
                            F.col("request_ts").alias("_ts"), F.lit(1).alias("_kind"), F.col("qty").alias("_add"))
    order = [F.col("_ts"), F.col("_kind"), F.col("order_id").asc_nulls_first()]
    added = {"_restocked": F.col("_add").cast("bigint")}

    def supplied(run: DataFrame, opening: DataFrame) -> DataFrame:
        # met by (product, chunk), as the running sum left the lines: they are not moved again
        return (run.filter(F.col("_kind") == 2).join(met_by_shuffle(opening), ["product_id", "_rchunk"], "left")
                .select("order_id", "product_id", "qty", "_cart", "_slice", F.col("_ts").alias("order_date"), "_rchunk",
                        (F.coalesce(F.col("opening_qty"), F.lit(0)) + F.col("_restocked")).alias("supply")))

    cold = mark_cold(ev_lines.unionByName(ev_rs), "product_id", hot)
    out = supplied(chunked_running_sum(cold, "product_id", F.col("_rchunk"), order, added, whole=True),
                   mark_cold(opening, "product_id", hot))
    if hot.isEmpty():
        return out, {"whole": True}, None
    own = [df.join(F.broadcast(hot), "product_id", "left_semi") for df in (ev_lines, ev_rs)]
    ev = assign_range_chunks(own[0].unionByName(own[1]), "product_id", order, write=lambda df: _store(df, root, "events"))
    spans = _store(spanning_keys(ev, "product_id"), root, "spans")
    pairs = _store(ev.filter(F.col("_kind") == 2).select("product_id", "_rchunk").distinct(), root, "pairs")
    run = chunked_running_sum(ev, "product_id", F.col("_rchunk"), order, added, spanning=spans)
    return out.unionByName(supplied(run, opening.join(F.broadcast(pairs), "product_id"))), {"spanning": spans}, pairs


def _store(df: DataFrame, root: str, name: str, by: str | None = None) -> DataFrame:
    """``df`` as the table ``name`` below ``root``, split by column ``by``."""
    writer = df.write if by is None else df.write.partitionBy(by)
    writer.option("compression", "zstd").parquet(os.path.join(root, name))
    return df.sparkSession.read.schema(df.schema).parquet(os.path.join(root, name))


def _open_lines(work: DataFrame, seq: list, **chunks) -> DataFrame:
    """The round's lines with ``lower`` and ``upper``.  ``chunks``: what is
    known of the products that lie in several chunks."""
    taken = F.when(F.col("state") == "A", F.col("qty")).otherwise(F.lit(0)).cast("bigint")
    return chunked_running_sum(work, "product_id", F.col("_rchunk"), seq,
                               {"lower": taken, "upper": F.col("qty").cast("bigint")},
                               inclusive=False, prepartitioned=True, **chunks)


def _replayer():
    """The replay as a local function, which travels to the executors by value."""
    def replay_orders(lines: pd.DataFrame) -> pd.DataFrame:
        """One component's open orders, one at a time: ``lower`` has what earlier
        accepted orders of all the batch took; the replay adds what its own take."""
        lines = lines.sort_values(["order_date", "order_id"], na_position="first", kind="stable")
        taken: dict[int, int] = {}
        states: dict[int, str] = {}
        rows: list[tuple[int, int]] = []
        fits, order = True, None

        def close() -> None:
            if order is not None:
                states[order] = "A" if fits else "R"
                if fits:
                    for product, qty in rows:
                        taken[product] = taken.get(product, 0) + qty

        for this, product, qty, lower, supply in zip(*(lines[c].tolist() for c in (
                "order_id", "product_id", "qty", "lower", "supply"))):
            if this != order:
                close()
                order, rows, fits = this, [], True
            rows.append((product, qty))
            fits = fits and lower + taken.get(product, 0) + qty <= supply
        close()
        return pd.DataFrame({"order_id": list(states), "state": list(states.values())})

    return replay_orders


def _replay(open_lines: DataFrame) -> DataFrame:
    """``order_id, state`` of the orders of open lines, replayed by
    ``_label``: each label's orders share no product with any other's."""
    return open_lines.select("_label", "order_id", "order_date", "product_id", "qty", "lower", "supply").groupBy(
        "_label").applyInPandas(_replayer(), "order_id bigint, state string")


def _closed_components(open_lines: DataFrame, root: str) -> DataFrame:
    """The open lines, with a ``_label``, of the components that label
    spreading has closed and that one task can replay.  Orders and products
    take the smallest label next to them; a label is closed when none of its
    products carries another."""
    links = _store(open_lines, root, "open")
    labels = links.select("order_id", F.col("order_id").alias("_label")).distinct()
    for step in range(SPREAD_STEPS):
        near = links.select("order_id", "product_id").join(met_by_shuffle(labels), "order_id")
        by_product = near.groupBy("product_id").agg(F.min("_label").alias("_label"))
        labels = _store(links.select("order_id", "product_id").join(met_by_shuffle(by_product), "product_id")
                        .groupBy("order_id").agg(F.min("_label").alias("_label")), root, f"labels-{step}")
        # a label is an order too: take on its label, which triples the reach of a step
        further = labels.select(F.col("order_id").alias("_label"), F.col("_label").alias("_next"))
        labels = labels.join(met_by_shuffle(further), "_label").select("order_id", F.col("_next").alias("_label"))
    labelled = links.join(met_by_shuffle(labels), "order_id")
    split = labelled.groupBy("product_id").agg(F.min("_label").alias("_a"), F.max("_label").alias("_b")).filter("_a < _b")
    unclosed = labelled.join(met_by_shuffle(split.select("product_id")), "product_id", "left_semi").select("_label")
    large = labelled.groupBy("_label").count().filter(F.col("count") > REPLAY_LINES).select("_label")
    return labelled.join(met_by_shuffle(unclosed.unionByName(large).distinct()), "_label", "left_anti")


def _reject_detail(lines: DataFrame, seq: list, chunks: dict) -> DataFrame:
    """For orders short of stock: the first failing line in cart order and
    the quantity that was available to it.  ``lines`` have their ``state``;
    of the rejected orders', only the ``tight`` ones may have failed."""
    refused = F.col("state") == "R"
    taken = F.when(~refused, F.col("qty")).otherwise(F.lit(0)).cast("bigint")
    moved = lines.filter(~refused | F.col("tight")).select(
        "order_id", "product_id", "qty", "order_date", "_rchunk", "state",
        *[F.when(refused, F.col(c)).alias(c) for c in ("_cart", "supply")])
    sums = chunked_running_sum(moved, "product_id", F.col("_rchunk"), seq, {"_taken": taken}, inclusive=False,
                               prepartitioned=True, **chunks)
    left = F.col("supply") - F.col("_taken")
    short = sums.filter((F.col("state") == "R") & (left < F.col("qty")))
    return short.groupBy("order_id").agg(F.min_by(
        F.struct("product_id", left.alias("available")), F.struct("_cart", "product_id")).alias("_f")).select(
        "order_id", F.col("_f.product_id").alias("failing_product_id"), F.col("_f.available").alias("available"))


def _sliced(headers: DataFrame, n: int) -> DataFrame:
    """``order_id, order_date`` with ``_slice``, one of ``n`` spans of time
    with about as many orders each.  A repeated order is all in one."""
    heads = headers.select("order_id", "order_date")
    bounds = [] if n == 1 else heads.agg(
        F.percentile_approx("order_date", [k / n for k in range(1, n)])).first()[0] or []
    if not bounds:
        return heads.withColumn("_slice", F.lit(0))
    after = [F.coalesce((F.col("order_date") > ntz(b)).cast("int"), F.lit(0)) for b in sorted(set(bounds))]
    return heads.withColumn("_slice", F.min(sum(after, F.lit(0))).over(Window.partitionBy("order_id")))


def _by_chunk(per_product: DataFrame, hot: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """A row per product as a row per (product, chunk) that holds its lines."""
    cold = mark_cold(per_product, "product_id", hot)
    return cold if pairs is None else cold.unionByName(per_product.join(F.broadcast(pairs), "product_id"))


def _decide_slice(lines: DataFrame, taken: DataFrame | None, chunks: dict, seq: list, rounds: str, rnd: int) -> int:
    """Decide a slice's lines in rounds, the first numbered ``rnd``; returns
    the number after the last.  ``taken``: what the slices before took, by
    (product, chunk).  Each round is a table ``rnd=N`` below ``rounds`` that
    holds the lines then open with their new state.  A line keeps its
    ``supply``, and in ``used`` what accepted orders took before it, so a
    round needs only the open lines and those accepted just before, of the
    products that are still open.  A line is ``tight`` if it may not fit."""
    spark, first = lines.sparkSession, rnd
    used = F.lit(0).cast("bigint")
    if taken is not None:
        lines = lines.join(met_by_shuffle(taken), ["product_id", "_rchunk"], "left")
        used = F.coalesce(F.col("_taken"), F.lit(0))
    work = lines.select(*LINE_COLS, used.alias("used"), F.lit("U").alias("state"))
    undecided, slow = None, False
    while undecided != 0:
        sums = _open_lines(work, seq, **chunks).filter(F.col("state") == "U")
        scratch, looked = f"{rounds}-work-{rnd}", False
        # written once, as both the verdict and the lines that it falls on need it
        sums = _store(sums.select(*LINE_COLS, (F.col("used") + F.col("lower")).alias("used"),
                                  (F.col("used") + F.col("upper") + F.col("qty") > F.col("supply")).alias("tight")),
                      scratch, "sums")
        bounded = sums.withColumnRenamed("used", "lower")
        if undecided is not None and undecided <= REPLAY_LINES:
            verdict = _replay(bounded.withColumn("_label", F.lit(0).cast("bigint"))).withColumnRenamed("state", "new")
        elif looked := slow:
            verdict = _store(_replay(_closed_components(bounded, scratch)).withColumnRenamed("state", "new"),
                             scratch, "replayed")
        else:
            verdict = bounded.groupBy("order_id").agg(
                (~F.bool_or("tight")).alias("_fits"),
                F.bool_or(F.col("lower") + F.col("qty") > F.col("supply")).alias("_fails")).select(
                "order_id", F.when(F.col("_fits"), "A").when(F.col("_fails"), "R").alias("new"))
        decided = sums.join(met_by_shuffle(verdict), "order_id", "left").withColumn(
            "state", F.coalesce("new", F.lit("U"))).drop("new")
        after = _store(decided, rounds, f"rnd={rnd}", by="state")
        before, undecided = undecided, after.filter(F.col("state") == "U").count()
        if rnd > first:
            remove_path(spark, os.path.join(rounds, f"rnd={rnd - 1}", "state=U"))
        remove_path(spark, scratch)
        # rejected lines take nothing and leave; those accepted just now count once more
        work = after.filter(F.col("state") == "U")
        accepted = after.filter(F.col("state") == "A")
        if undecided <= OPEN_PRODUCTS:
            accepted = accepted.join(F.broadcast(work.select("product_id").distinct()), "product_id", "left_semi")
        work = work.unionByName(accepted.select(*[
            F.lit(None).cast("bigint").alias(c) if c in ("_cart", "supply", "used") else F.col(c) for c in work.columns]))
        slow = not looked and before is not None and before - undecided < SLOW_ROUND * before
        rnd += 1
    return rnd


def bill_batch(t: Tables, lines: DataFrame, headers: DataFrame, opening: DataFrame,
               restocks: DataFrame) -> DataFrame:
    """Decide every order: ``accepted``, or ``rejected`` with a reason, the
    first failing product in cart order and (for short stock) the quantity
    available to it.  Stock-independent reasons (missing input, customer,
    unknown product, expired on the order date) come from
    :func:`billing.validate_carts`.  ``lines`` should be materialised; the
    rounds run, as jobs, while the result is being built, and the result is a
    checkpoint."""
    root, tables = scratch_path(t.spark, "admission"), []
    try:
        return cut_lineage(_decide(t, lines, headers, opening, restocks, root, tables))
    finally:
        drop_tables(t.spark, tables)
        remove_path(t.spark, root)


def _decide(t: Tables, lines: DataFrame, headers: DataFrame, opening: DataFrame, restocks: DataFrame,
            root: str, tables: list[str]) -> DataFrame:
    """:func:`bill_batch` over tables written below ``root``, some of them named in ``tables``."""
    restocks = _store(restocks.select("product_id", "qty", "request_ts"), root, "restocks")
    static = _store(billing.validate_carts(t, lines, headers, None, check_stock=False), root, "static")
    ok = static.filter(F.col("status") == "ok").select("order_id")
    cart_order = F.col("pos") if "pos" in lines.columns else F.col("first_line")
    n_slices = max(1, min(MAX_SLICES, -(-lines.count() // SLICE_LINES)))
    work = (lines.select("order_id", "product_id", "qty", cart_order.cast("bigint").alias("_cart"))
            .join(met_by_shuffle(ok), "order_id", "left_semi")
            .join(met_by_shuffle(_sliced(headers, n_slices)), "order_id"))
    # The chunks along (product, order time) are assigned once and kept:
    # dropping restocks and decided lines never breaks their contiguity.
    hot = hot_keys(lines.select("product_id").unionByName(restocks.select("product_id")), "product_id")
    supplied, chunks, pairs = supply_per_line(work, opening, restocks, hot, root)
    every_line = deal_out(supplied, os.path.join(root, "lines"), ["product_id", "_rchunk"], tables, by="_slice")
    remove_path(t.spark, os.path.join(root, "events"))
    seq = [F.col("order_date"), F.col("order_id")]
    rounds, rnd, taken = os.path.join(root, "rounds"), 1, None
    row = every_line.drop("_slice").select(*LINE_COLS).schema
    schema = StructType([*row.fields, StructField("used", LongType()), StructField("tight", BooleanType()),
                         StructField("rnd", IntegerType()), StructField("state", StringType())])
    for part in range(n_slices):
        by_chunk = None if taken is None else _by_chunk(taken, hot, pairs)
        first, rnd = rnd, _decide_slice(every_line.filter(F.col("_slice") == part).drop("_slice"), by_chunk, chunks,
                                        seq, rounds, rnd)
        done = t.spark.read.schema(schema).parquet(rounds).filter(F.col("state") != "U")
        if part + 1 < n_slices:
            sold = done.filter((F.col("state") == "A") & (F.col("rnd") >= first)).select(
                "product_id", F.col("qty").cast("bigint").alias("_taken"))
            sold = sold if taken is None else sold.unionByName(taken)
            taken = _store(sold.groupBy("product_id").agg(F.sum("_taken").alias("_taken")), root, f"taken-{part}")
    # an order's lines are all decided in the same round
    decisions = done.groupBy("order_id").agg(
        F.first("state").alias("_s"), F.first("rnd").alias("decided_round")).select(
        "order_id", F.when(F.col("_s") == "A", "accepted").otherwise("rejected").alias("decision"), "decided_round")
    detail = _reject_detail(done, seq, chunks)
    by_stock = decisions.join(met_by_shuffle(detail), "order_id", "left").select(
        "order_id", "decision", F.when(F.col("decision") == "rejected", "short_stock").alias("reason"),
        "failing_product_id", "available", "decided_round")
    by_input = static.filter(F.col("status") == "rejected").select(
        "order_id", F.lit("rejected").alias("decision"), "reason", "failing_product_id",
        F.lit(None).cast("bigint").alias("available"), F.lit(0).alias("decided_round"))
    return by_stock.unionByName(by_input).select(*DECISION_COLS)


def admitted_sales(t: Tables, decisions: DataFrame, lines: DataFrame, headers: DataFrame) -> DataFrame:
    """Sale ledger input for accepted orders (one row per cart line)."""
    acc = decisions.filter(F.col("decision") == "accepted").select("order_id")
    return (lines.join(met_by_shuffle(acc), "order_id", "left_semi")
            .join(met_by_shuffle(headers.select("order_id", "cashier_id", "order_date")), "order_id")
            .select("order_id", "product_id", F.col("pos").alias("line_no"),
                    F.col("qty").alias("qty_sold"), "cashier_id", "order_date"))


def decide_fixture_batch(t: Tables, as_of: dt.date, lines_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(decisions, cart lines) of the registered batch, the decisions a
    checkpoint and the lines a table (at ``lines_path``, replaced): every order
    of the tables, opening stock p_size x 20 and the scheduled restocks."""
    lines = D.cart_lines(t)
    path, tables = lines_path or scratch_path(t.spark, "cart-lines"), []
    try:
        # numbered by the order, the lines are stored by the order too
        dealt = deal_out(lines, path, ["order_id"], tables)
        decisions = bill_batch(t, dealt, D.cart_headers(t), D.opening_stock(t), billing.accepted_restocks(t, as_of))
    finally:
        drop_tables(t.spark, tables)
    return decisions, t.spark.read.schema(lines.schema).parquet(path)


#: The tables that the registered batch is decided from.
BATCH_TABLES = ("part", "customer", "orders", "lineitem")


def store_batch(t: Tables, as_of: dt.date) -> str:
    """Decide the registered batch and store its outcome for the present
    version of the tables' files; a version that is stored is left as it is.
    Returns the folder (``decisions`` and ``lines`` below it)."""
    root = os.path.join(checkpoint_root(t.spark), "tillwise", "batches", f"{t.version(BATCH_TABLES)}-{as_of}")
    if not path_exists(t.spark, os.path.join(root, "decisions", "_SUCCESS")):
        decisions, _ = decide_fixture_batch(t, as_of, os.path.join(root, "lines"))
        decisions.write.mode("overwrite").parquet(os.path.join(root, "decisions"))  # last: it marks the outcome whole
    return root


def fixture_batch(t: Tables, as_of: dt.date) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(decisions, cart lines, headers) of the registered batch.

    A checkout is decided once and its outcome stored (:func:`store_batch`);
    the ledger, the alerts and the reports read that.  The outcome belongs to
    a version of the input files: once a file has changed, the batch is
    decided anew.  A bundle of given frames keeps its own."""
    if t.is_stored():
        if (root := t.__dict__.get("_batch_root", {}).get(as_of)) is None:
            # a bundle reads one version from beginning to end
            root = t.__dict__.setdefault("_batch_root", {})[as_of] = store_batch(t, as_of)
        decisions, lines = (t.spark.read.parquet(os.path.join(root, x)) for x in ("decisions", "lines"))
    else:
        memo = t.__dict__.setdefault("_batch", {})
        if as_of not in memo:
            memo[as_of] = decide_fixture_batch(t, as_of)
        decisions, lines = memo[as_of]
    return decisions, lines, D.cart_headers(t)


def bill_fixture_batch(t: Tables, as_of: dt.date) -> DataFrame:
    """Decisions of the registered batch, decided anew."""
    path = scratch_path(t.spark, "cart-lines")
    try:
        return decide_fixture_batch(t, as_of, path)[0]
    finally:
        remove_path(t.spark, path)


def fixture_sales(t: Tables, as_of: dt.date) -> DataFrame:
    """Sale rows of the registered batch: the accepted orders' lines."""
    decisions, lines, heads = fixture_batch(t, as_of)
    return admitted_sales(t, decisions, lines, heads)


def admitted_items(t: Tables, as_of: dt.date) -> DataFrame:
    """Lines of the accepted orders at current prices."""
    sales = fixture_sales(t, as_of)
    price = t.product_base.select("product_id", F.col("price").alias("unit_price"))
    return sales.join(met_by_shuffle(price), "product_id").select(
        "order_id", "product_id", "line_no", "qty_sold", "unit_price",
        (F.col("unit_price") * F.col("qty_sold")).cast("decimal(12,2)").alias("line_total"), "order_date")


def admitted_orders(t: Tables, as_of: dt.date) -> DataFrame:
    """Priced headers of the accepted orders."""
    decisions, lines, heads = fixture_batch(t, as_of)
    accepted = met_by_shuffle(decisions.filter(F.col("decision") == "accepted").select("order_id"))
    priced = billing.price_carts(t, lines.join(accepted, "order_id", "left_semi"),
                                 heads.join(accepted, "order_id", "left_semi"))
    dates = met_by_shuffle(heads.select("order_id", "order_date"))
    return priced.drop("status", "reason", "failing_product_id").join(dates, "order_id")


def rejected_carts(t: Tables, as_of: dt.date) -> DataFrame:
    """Rejected orders: reason, failing product, quantity available to it."""
    return fixture_batch(t, as_of)[0].filter(F.col("decision") == "rejected").select(
        "order_id", "reason", "failing_product_id", "available")


def product_stock(t: Tables, as_of: dt.date) -> DataFrame:
    """Products with the stock that the batch leaves: opening stock plus
    accepted restocks minus admitted sales, from those inputs (not from the
    ledger), one aggregate each."""
    added = billing.accepted_restocks(t, as_of).groupBy("product_id").agg(F.sum("qty").alias("_in"))
    sold = fixture_sales(t, as_of).groupBy("product_id").agg(F.sum("qty_sold").alias("_out"))
    p = t.product_base.drop("stock_qty")
    for side, how in [(D.opening_stock(t), "inner"), (added, "left"), (sold, "left")]:
        p = p.join(met_by_shuffle(side), "product_id", how)
    stock = F.col("opening_qty") + F.coalesce("_in", F.lit(0)) - F.coalesce("_out", F.lit(0))
    return p.select(*[c for c in t.product_base.columns if c != "stock_qty"], stock.cast("bigint").alias("stock_qty"))


def bill_batch_outputs(t: Tables, as_of: dt.date) -> dict[str, DataFrame]:
    """The checkout's four outputs for the whole batch: priced accepted
    orders, their items at current prices, the stock ledger with the
    admitted sales, and the rejected orders with reasons."""
    from tillwise.operators import ledger as L
    return {"orders": admitted_orders(t, as_of), "items": admitted_items(t, as_of),
            "ledger": L.stock_ledger(t, as_of), "rejected": rejected_carts(t, as_of)}


def commit_outputs(outputs: dict[str, DataFrame], root: str, batch_id: int = 0) -> dict[str, str]:
    """Write a batch's orders, items and ledger rows to month-partitioned
    fact tables below ``root``, and the rejected orders beside them.  Every
    table has one folder per batch, written with overwrite: a repeated
    commit of the same batch replaces its rows and never doubles them."""
    paths = {}
    for name, time_col, sort_by in [("orders", "order_date", "order_id"),
                                     ("items", "order_date", "order_id"),
                                     ("ledger", "log_time", "product_id"),
                                     ("rejected", None, None)]:
        path = os.path.join(root, name)
        if time_col is None:
            outputs[name].write.mode("overwrite").parquet(os.path.join(path, f"batch_id={batch_id}"))
        else:
            sinks.append_facts(outputs[name], path, time_col, sort_by=sort_by, batch_id=batch_id)
        paths[name] = path
    return paths
