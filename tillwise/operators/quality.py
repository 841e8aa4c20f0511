"""Data-quality checks: the schema's constraints evaluated as one Spark job.

Each table is read once and its rows become events: the rules a row breaks and
the keys it holds, as a parent or as a child.  One aggregate over the events of
all tables counts them per key; uniqueness, foreign keys and row rules are all
read off those counts.  The result is one row per (rule, check) with the
number of violating rows or keys.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.operators import ledger
from tillwise.operators.changes import PHONE_PATTERN, norm_key
from tillwise.plans.lineage import cut_lineage
from tillwise.sources.tables import Tables

# --- fixed values: enum domains and column widths of the retail schema -------
ROLES = ["admin", "manager", "cashier", "customer"]
PAYMENT_MODES = ["cash", "card", "upi", "other"]
ORDER_STATUSES = ["pending", "completed", "cancelled"]
LEDGER_REASONS = ["sale", "restock", "adjustment", "expired_removal"]
ALERT_TYPES = ["low_stock", "expiry_warning", "expired", "info"]
MAX_LEN = {"category_name": 100, "username": 50, "full_name": 100, "name": 150,
           "barcode": 50, "phone_no": 15, "rule_name": 100}


#: What one row says: its table breaks rule ``slot`` of topic ``rule``; or it holds key
#: (``id`` or ``word``) of a topic, in the part that ``slot`` numbers.
EVENT = "struct<topic:int,id:bigint,word:string,slot:int>"
SLOTS = 5


def _event(topic: int, slot: int, id: Column | None = None, word: Column | None = None) -> Column:
    return F.struct(F.lit(topic).alias("topic"), (F.lit(None) if id is None else id).cast("bigint").alias("id"),
                    (F.lit(None) if word is None else word).cast("string").alias("word"),
                    F.lit(slot).alias("slot"))


class _Checks:
    """The checks, and every table's rows as events.

    A table is read once: each row becomes the keys it holds and the rules it
    breaks.  All events are counted per key in one aggregate, map-side first,
    and every check is read off those counts: a rule's violations, a key seen
    twice, a child key without a parent, a parent without a child."""

    def __init__(self):
        self.topics: dict[str, int] = {"rule": 0}       # topic -> its number in the events
        self.names: list[tuple[str, str]] = []     # (rule, check) by number
        self.unique: dict[str, int] = {}           # topic -> check
        self.children: dict[str, dict[int, int]] = {}   # parent topic -> slot -> check
        self.childless: dict[str, tuple[int, int]] = {}  # parent topic -> (child slot, check)
        self.events: list[DataFrame] = []

    def _topic(self, name: str) -> int:
        return self.topics.setdefault(name, len(self.topics))

    def _number(self, rule: str, name: str) -> int:
        self.names.append((rule, name))
        return len(self.names) - 1

    def child(self, parent: str, name: str, key: str, childless: str | None = None) -> Column:
        """A foreign key's event; slot 0 of the topic is the parent's own key."""
        slots = self.children.setdefault(parent, {})
        slot = len(slots) + 1
        assert slot < SLOTS
        slots[slot] = self._number("DQ-6", name)
        if childless is not None:
            self.childless[parent] = (slot, self._number("DQ-9", childless))
        return F.when(F.col(key).isNotNull(), _event(self._topic(parent), slot, id=F.col(key)))

    def parent(self, topic: str, key: str) -> Column:
        return F.when(F.col(key).isNotNull(), _event(self._topic(topic), 0, id=F.col(key)))

    def distinct(self, name: str, key: Column) -> Column:
        topic = f"unique {name}"
        self.unique[topic] = self._number("DQ-5", name)
        return F.when(key.isNotNull(), _event(self._topic(topic), 0, word=key))

    def table(self, df: DataFrame, rules: list[tuple[str, str, Column]], keys: list[Column] = ()) -> None:
        """Add a table: ``rules`` hold for the rows that break them."""
        broken = [F.when(cond, _event(self._topic("rule"), 0, id=F.lit(self._number(rule, name)))) for rule, name, cond in rules]
        # what is not said is null and falls out after the generator, which Spark compiles
        said = F.array(*broken, *keys).cast(f"array<{EVENT}>")
        self.events.append(df.select(F.inline(said)).filter(F.col("topic").isNotNull()))

    def result(self) -> DataFrame:
        """One row per (rule, check), zero where nothing is wrong."""
        every = self.events[0]
        for part in self.events[1:]:
            every = every.unionByName(part)
        n = [F.col(f"n{i}") for i in range(SLOTS)]
        counted = every.groupBy("topic", "id", "word").agg(
            *[F.count_if(F.col("slot") == i).alias(f"n{i}") for i in range(SLOTS)])

        def found(check: Column | int, cond: Column, violations: Column) -> Column:
            number = F.lit(check) if isinstance(check, int) else check
            return F.when(cond & (violations > 0), F.struct(number.cast("int").alias("check"),
                                                            violations.cast("bigint").alias("violations")))

        def about(topic: str) -> Column:
            return F.col("topic") == self._topic(topic)

        out = [found(F.col("id"), about("rule"), n[0])]
        out += [found(check, about(t) & (n[0] > 1), F.lit(1)) for t, check in self.unique.items()]
        out += [found(check, about(t) & (n[0] == 0), n[slot])
                for t, slots in self.children.items() for slot, check in slots.items()]
        out += [found(check, about(t) & (n[slot] == 0), n[0]) for t, (slot, check) in self.childless.items()]
        wrong = counted.select(F.inline(F.filter(F.array(*out), lambda x: x.isNotNull())))
        spark = counted.sparkSession
        zeros = spark.createDataFrame([(i, 0) for i in range(len(self.names))], "check int, violations long")
        rules, names = (F.array(*[F.lit(x[k]) for x in self.names]) for k in (0, 1))
        return (wrong.unionByName(zeros).groupBy("check").agg(F.sum("violations").cast("bigint").alias("violations"))
                .select(F.get(rules, F.col("check")).alias("rule"), F.get(names, F.col("check")).alias("check_name"),
                        "violations"))


def _orphans_by_parent(rule: str, checks: list[tuple[str, DataFrame, str]], parent: DataFrame,
                       pk: str) -> DataFrame:
    """Foreign-key checks of several children (name, table, key) against one
    parent, by the same counts; one row per check."""
    k = _Checks()
    k.table(parent, [], [k.parent("parent", pk)])
    for name, child, fk in checks:
        k.table(child, [], [k.child("parent", name, fk)])
    return k.result().withColumn("rule", F.lit(rule))


def _orphans(rule: str, name: str, child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    return _orphans_by_parent(rule, [(name, child, fk)], parent, pk)


def _too_long(c: str) -> Column:
    return F.length(F.col(c)) > MAX_LEN[c]


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit("")) == ""


def data_quality(t: Tables, as_of: dt.date) -> DataFrame:
    p, u, o, i, c = t.product, t.app_user, t.sales_orders, t.order_items, t.category
    # The ledger feeds three checks and the alerts: write it once.
    led = cut_lineage(ledger.stock_ledger(t, as_of))
    alerts = ledger.all_alerts(t, as_of, ledger.running_stock(t, as_of, led))
    k = _Checks()
    k.table(p, [
        ("DQ-2", "product.price >= 0", F.col("price") < 0),
        ("DQ-3", "product.stock_qty >= 0", F.col("stock_qty") < 0),
        ("DQ-8", "product.name not null", F.col("name").isNull()),
        ("DQ-8", "product.name length", _too_long("name")),
        ("DQ-8", "product.barcode length", _too_long("barcode")),
        ("DQ-8", "product.category_id not null", F.col("category_id").isNull()),
        ("DQ-8", "product.price not null", F.col("price").isNull()),
        ("DQ-9", "product.name present", _blank("name")),
    ], [k.parent("product", "product_id"), k.child("category", "product -> category", "category_id"),
        k.distinct("product.barcode unique", norm_key(F.col("barcode")))])
    k.table(u, [
        ("DQ-1", "user.phone_no ten digits", F.col("phone_no").isNotNull()
         & ~F.col("phone_no").rlike(PHONE_PATTERN)),
        ("DQ-7", "user.role domain", ~F.coalesce(F.col("role").isin(ROLES), F.lit(False))),
        ("DQ-8", "user.username not null", F.col("username").isNull()),
        ("DQ-8", "user.username length", _too_long("username")),
        ("DQ-8", "user.full_name not null", F.col("full_name").isNull()),
        ("DQ-8", "user.full_name length", _too_long("full_name")),
        ("DQ-8", "user.phone_no length", _too_long("phone_no")),
        ("DQ-9", "user.username present", _blank("username")),
        ("DQ-9", "user.full_name present", _blank("full_name")),
    ], [k.parent("user", "user_id"), k.distinct("user.username unique", norm_key(F.col("username")))])
    k.table(o, [
        ("DQ-7", "orders.payment_mode domain",
         ~F.coalesce(F.col("payment_mode").isin(PAYMENT_MODES), F.lit(False))),
        ("DQ-7", "orders.status domain", ~F.coalesce(F.col("status").isin(ORDER_STATUSES), F.lit(False))),
        ("DQ-9", "orders.discount <= subtotal", F.col("discount") > F.col("subtotal")),
        ("DQ-9", "orders.customer_id present", F.col("customer_id").isNull()),
        ("DQ-8", "orders.cashier_id not null", F.col("cashier_id").isNull()),
    ], [k.parent("orders", "order_id"), k.child("user", "orders -> customer", "customer_id"),
        k.child("user", "orders -> cashier", "cashier_id")])
    k.table(i, [
        ("DQ-4", "order_items.qty_sold > 0", F.col("qty_sold") <= 0),
        ("DQ-8", "order_items.qty_sold not null", F.col("qty_sold").isNull()),
        ("DQ-8", "order_items.unit_price not null", F.col("unit_price").isNull()),
    ], [k.child("orders", "order_items -> orders", "order_id", childless="orders have items"),
        k.child("product", "order_items -> product", "product_id")])
    k.table(t.discount_rules, [
        ("DQ-8", "rule.name not null", F.col("rule_name").isNull()),
        ("DQ-8", "rule.name length", _too_long("rule_name")),
        ("DQ-8", "rule.discount_pct not null", F.col("discount_pct").isNull()),
    ])
    k.table(c, [
        ("DQ-8", "category.name not null", F.col("category_name").isNull()),
        ("DQ-8", "category.name length", _too_long("category_name")),
    ], [k.parent("category", "category_id"), k.distinct("category.name unique", norm_key(F.col("category_name")))])
    k.table(led, [("DQ-7", "stock_log.reason domain",
                   ~F.coalesce(F.col("reason").isin(LEDGER_REASONS), F.lit(False)))],
            [k.child("product", "stock_log -> product", "product_id")])
    k.table(alerts, [("DQ-7", "notification.type domain",
                      ~F.coalesce(F.col("type").isin(ALERT_TYPES), F.lit(False)))],
            [k.child("product", "notification -> product", "product_id")])
    return k.result()
