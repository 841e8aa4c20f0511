"""Change feeds applied as set operations: upserts, registrations,
insert-if-absent.

Per-key "latest value" is an aggregate (``max_by``) rather than a
``row_number`` window, so it combines map-side and a key with a huge
history does not land in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.plans.running import assign_range_chunks, chunked_running_sum
from tillwise.sources.tables import Tables

PHONE_PATTERN = "^[0-9]{10}$"
CHANGE_FIELDS = ["name", "price", "reorder_level", "expiry_date", "warning_label",
                 "category_id", "barcode", "is_active"]
DEFAULT_REORDER_LEVEL = 10


def norm_key(c: Column) -> Column:
    """Case- and padding-insensitive key (the database's _ci collation)."""
    return F.lower(F.trim(c))


def latest_fields(changes: DataFrame, key: str, fields: Sequence[str],
                  version: str = "version", first: Sequence[str] = ()) -> DataFrame:
    """Per key: for each field, its value in the highest version that set
    it (NULL = "not changed"), plus the last version and change time.  Of the
    ``first`` fields, the value in the lowest version (no such column: NULL)."""
    starts = [(F.min_by(F.col(f), F.col(version)) if f in changes.columns else F.max(F.lit(None))).alias(f)
              for f in first]
    aggs = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(version))).alias(f) for f in fields]
    return changes.groupBy(key).agg(F.max(version).alias("version"),
                                    F.max("changed_at").alias("updated_at"), *aggs, *starts)


def apply_product_changes(t: Tables, changes: DataFrame) -> DataFrame:
    """Upsert a product change feed into a new product snapshot.  Unchanged
    products pass through; new ids are inserted with the defaults.  The feed
    may have a ``stock_qty``: a new product gets that of its first version
    (none: 0); for a known product it is ignored, as only sales and restocks
    move its stock."""
    latest = latest_fields(changes, "product_id", CHANGE_FIELDS, first=["stock_qty"])
    c = latest.select("product_id", "updated_at", F.col("stock_qty").cast("int").alias("_c_stock_qty"),
                      *[F.col(f).alias(f"_c_{f}") for f in CHANGE_FIELDS])
    p = t.product.withColumn("_known", F.lit(True))
    j = p.join(c, "product_id", "full")
    cols = {f: F.coalesce(F.col(f"_c_{f}"), F.col(f)) for f in CHANGE_FIELDS}
    cols["reorder_level"] = F.coalesce(cols["reorder_level"], F.lit(DEFAULT_REORDER_LEVEL))
    cols["is_active"] = F.coalesce(cols["is_active"], F.lit(True))
    change = (F.when(F.col("updated_at").isNull(), "none")
               .when(F.col("_known").isNull(), "insert").otherwise("update"))
    return j.select("product_id", cols["barcode"].alias("barcode"), cols["name"].alias("name"),
                    cols["price"].alias("price"),
                    F.when(F.col("_known"), F.col("stock_qty"))
                     .otherwise(F.coalesce(F.col("_c_stock_qty"), F.lit(0))).alias("stock_qty"),
                    cols["reorder_level"].alias("reorder_level"), cols["expiry_date"].alias("expiry_date"),
                    cols["warning_label"].alias("warning_label"), cols["category_id"].alias("category_id"),
                    cols["is_active"].alias("is_active"), "updated_at", change.alias("change"))


def created_products(t: Tables, changes: DataFrame) -> DataFrame:
    """The new products of a change feed as their first version gave them:
    what the triggers on a product insert see."""
    row = F.struct("name", "expiry_date", "changed_at",
                   (F.col("stock_qty") if "stock_qty" in changes.columns else F.lit(None)).cast("int").alias("stock_qty"))
    first = changes.groupBy("product_id").agg(F.min_by(row, F.col("version")).alias("_row"))
    return (first.join(t.product.select("product_id"), "product_id", "left_anti")
            .select("product_id", "_row.*").fillna(0, ["stock_qty"]))


def register_customers(t: Tables, requests: DataFrame) -> DataFrame:
    """Register a batch of customers in request order.  A request is
    refused when input is missing, when its username (case-insensitive) is
    taken by an existing user or by an earlier valid request, or when the
    phone is not ten digits.  Accepted rows always get the customer role."""
    r = requests.withColumn("_k", norm_key(F.col("username")))
    missing = (F.col("_k").isNull() | (F.col("_k") == "")
               | F.col("full_name").isNull() | (F.trim(F.col("full_name")) == ""))
    bad_phone = F.col("phone_no").isNotNull() & ~F.col("phone_no").rlike(PHONE_PATTERN)
    r = r.withColumn("_valid", ~missing & ~bad_phone)
    first_valid = (r.filter("_valid").groupBy("_k").agg(F.min("request_id").alias("_first")))
    taken = t.app_user.select(norm_key(F.col("username")).alias("_k")).distinct() \
                      .withColumn("_taken", F.lit(True))
    j = r.join(first_valid, "_k", "left").join(taken, "_k", "left")
    reason = (F.when(missing, "missing_input")
               .when(F.col("_taken").isNotNull(), "username_taken")
               .when(F.col("_first") < F.col("request_id"), "username_taken")
               .when(bad_phone, "bad_phone"))
    return j.select("request_id", F.trim(F.col("username")).alias("username"), "full_name", "phone_no",
                    F.lit("customer").alias("role"),
                    F.when(reason.isNull(), "accepted").otherwise("rejected").alias("status"),
                    reason.alias("reason"))


def insert_ignore(existing: DataFrame, incoming: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """INSERT IGNORE: add incoming rows whose normalised key is new; the
    first row per key (by ``order``) wins inside the batch."""
    cols = incoming.columns
    firsts = (incoming.withColumn("_k", norm_key(F.col(key)))
              .groupBy("_k")
              .agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_row")))
    have = existing.select(norm_key(F.col(key)).alias("_k")).distinct()
    return firsts.join(have, "_k", "left_anti").select("_k", "_row.*")


def insert_categories(t: Tables) -> DataFrame:
    """Categories after inserting brand names (new) and upper-cased type
    names (already present, ignored).  New ids continue after the largest
    existing id, in name order."""
    part = t.raw("part")
    incoming = (part.select(F.upper("p_type").alias("category_name"), F.lit(0).alias("seq"))
                .unionByName(part.select(F.col("p_brand").alias("category_name"), F.lit(1).alias("seq")))
                .unionByName(part.select(F.lower("p_brand").alias("category_name"), F.lit(2).alias("seq"))))
    fresh = insert_ignore(t.category, incoming, "category_name", ["seq", "category_name"])
    # new names are counted by ranges of their order; one row holds the largest id
    counted = chunked_running_sum(assign_range_chunks(fresh.withColumn("_all", F.lit(0)), "_all", [F.col("_k")]),
                                  "_all", F.col("_rchunk"), [F.col("_k")], {"_nth": F.lit(1)}, prepartitioned=True)
    largest = t.category.agg(F.coalesce(F.max("category_id"), F.lit(0)).alias("_largest"))
    added = counted.join(F.broadcast(largest))
    return (t.category.select("category_id", "category_name", F.lit(False).alias("inserted"))
            .unionByName(added.select((F.col("_largest") + F.col("_nth")).cast("bigint").alias("category_id"),
                                      "category_name", F.lit(True).alias("inserted"))))
