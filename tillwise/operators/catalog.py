"""Catalog, search and user listings (filters and projections).

Predicates are added as separate ``filter`` calls so Catalyst sees all of them
at once and pushes the raw-column ones into the Parquet scan.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.functions import scalar as S
from tillwise.sources.tables import Tables

PRODUCT_COLS = ["product_id", "barcode", "name", "price", "stock_qty", "reorder_level",
                "expiry_date", "warning_label", "category_id", "is_active"]


def list_categories(t: Tables) -> DataFrame:
    return t.category.select("category_id", "category_name").orderBy("category_name")


def _category_name(t: Tables, category_id: int):
    """The name of a category id (a lookup in the small stored table), so the
    filter can go to the product type and with it to the scan."""
    row = t.category_lookup.filter(F.col("category_id") == F.lit(category_id)).first()
    return row.category_name if row else None


def product_catalog(t: Tables, as_of: dt.date, category=None, search: str | None = None,
                    sellable: bool = False) -> DataFrame:
    """Active products with category name and days to expiry, by name."""
    p = t.product_named.filter(F.col("is_active"))
    if sellable:
        p = p.filter(F.col("stock_qty") > 0).filter(
            F.col("expiry_date").isNull() | (F.col("expiry_date") >= F.lit(as_of)))
    if category is not None:
        p = p.filter(F.col("category_name") == F.lit(_category_name(t, category)))
    if search:
        p = p.filter(S.contains_ci(F.col("name"), search) | S.contains_ci(F.col("barcode"), search))
    out = p.select(
        *PRODUCT_COLS, "category_name",
        S.days_until(F.col("expiry_date"), as_of).alias("days_to_expiry"))
    return out.orderBy("name", "product_id")


def sellable_products(t: Tables, as_of: dt.date) -> DataFrame:
    """The cashier's view: active, in stock, not expired."""
    p = (t.product_typed.filter(F.col("is_active")).filter(F.col("stock_qty") > 0)
         .filter(F.col("expiry_date").isNull() | (F.col("expiry_date") >= F.lit(as_of))))
    return p.select(
        "product_id", "barcode", "name", "price", "stock_qty", "warning_label",
        "category_name", S.days_until(F.col("expiry_date"), as_of).alias("days_to_expiry"))


def low_stock_products(t: Tables, as_of: dt.date) -> DataFrame:
    return product_catalog(t, as_of).filter(F.col("stock_qty") <= F.col("reorder_level"))


def expiring_products(t: Tables, as_of: dt.date, days: int = 30) -> DataFrame:
    return product_catalog(t, as_of).filter(F.col("days_to_expiry").between(0, days))


def expiry_alerts(t: Tables, as_of: dt.date, days: int = 30, n: int | None = None) -> DataFrame:
    """In-stock products expiring within ``days`` days, soonest first."""
    p = (t.product_typed.filter(F.col("expiry_date").isNotNull())
         .filter(F.col("expiry_date") >= F.lit(as_of))
         .filter(F.col("expiry_date") <= F.lit(as_of + dt.timedelta(days=days)))
         .filter(F.col("stock_qty") > 0))
    out = p.select(
        "product_id", "name", "stock_qty", "expiry_date",
        S.days_until(F.col("expiry_date"), as_of).alias("days_remaining"), "category_name")
    out = out.orderBy("days_remaining", "product_id")
    return out if n is None else out.limit(n)


def product_by_id(t: Tables, ids: DataFrame | int) -> DataFrame:
    """Point lookups: one id, or a batch of ids (a DataFrame with
    ``product_id``) resolved with a semi join."""
    if isinstance(ids, int):
        p = t.product_named.filter(F.col("product_id") == F.lit(ids))
    else:
        p = t.product_named.join(ids.select("product_id").distinct(), "product_id", "left_semi")
    return p.select(*PRODUCT_COLS, "category_name")


def stock_status(t: Tables) -> DataFrame:
    p = t.product_base
    return p.select("product_id", "stock_qty", "reorder_level",
                    S.stock_status(F.col("stock_qty"), F.col("reorder_level")).alias("stock_status"),
                    F.when(F.col("stock_qty") <= 0, "out").otherwise("ok").alias("stock_flag"))


def expiry_status(t: Tables, as_of: dt.date) -> DataFrame:
    p = t.product_base.filter(F.col("expiry_date").isNotNull())
    days = S.days_until(F.col("expiry_date"), as_of)
    return p.select("product_id", "expiry_date", days.alias("days_to_expiry"),
                    S.expiry_status(days).alias("expiry_status"),
                    S.expiring_soon(days).alias("expiring_soon"))


USER_COLS = ["user_id", "username", "role", "full_name", "phone_no", "is_active"]


def users_by_role(t: Tables, role: str | None = None) -> DataFrame:
    """Users without secrets, ordered by role declaration order then name."""
    u = t.app_user
    if role is not None:
        u = u.filter(F.col("role") == role)
    return (u.select(*USER_COLS, S.role_rank(F.col("role")).alias("_rank"))
            .orderBy("_rank", "full_name", "user_id").drop("_rank"))


def search_customers(t: Tables, search: str | None, n: int = 20) -> DataFrame:
    u = t.app_user.filter(F.col("role") == "customer").filter(F.col("is_active"))
    if search:
        u = u.filter(S.contains_ci(F.col("full_name"), search)
                     | S.contains_ci(F.col("phone_no"), search)
                     | S.contains_ci(F.col("username"), search))
    return (u.select("user_id", "username", "full_name", "phone_no")
            .orderBy("full_name", "user_id").limit(n))


def scalar_functions(t: Tables, as_of: dt.date) -> DataFrame:
    """The reference's scalar function surface applied to every product."""
    p = t.product_typed
    days = S.days_until(F.col("expiry_date"), as_of)
    return p.select(
        "product_id",
        F.upper(F.col("name")).alias("name_upper"),
        F.lower(F.col("name")).alias("name_lower"),
        S.first_token(F.col("name")).alias("first_word"),
        S.first_token(F.col("warning_label")).alias("label_word"),
        F.trim(F.concat(F.lit("  "), F.col("name"), F.lit(" "))).alias("name_trim"),
        F.concat(F.lit("Product "), F.col("name"), F.lit(" costs "),
                 F.col("price").cast("string")).alias("price_text"),
        S.display_date(F.col("expiry_date")).alias("expiry_display"),
        days.alias("days_to_expiry"),
        F.date_format(F.col("expiry_date"), "yyyy-MM").alias("expiry_month"),
        F.date_sub(F.col("expiry_date"), 30).alias("expiry_minus_30"),
        F.add_months(F.col("expiry_date"), -6).alias("expiry_minus_6m"),
        F.round(F.col("price") * F.lit(0.18).cast("decimal(3,2)"), 2).cast("decimal(12,2)").alias("gst"),
        F.greatest(F.col("price") - F.lit(1000).cast("decimal(12,2)"),
                   F.lit(0).cast("decimal(12,2)")).cast("decimal(12,2)").alias("price_over_1000"),
        F.coalesce(F.col("warning_label"), F.lit("none")).alias("label_or_none"),
        F.coalesce(F.col("barcode"), F.lit("No barcode")).alias("barcode_shown"),
        F.expr("try_cast(barcode AS BIGINT)").alias("barcode_number"),
        F.col("barcode").rlike("^[0-9]{13}$").alias("barcode_valid"),
        F.col("name").contains("ring").alias("has_ring"),
        S.category_icon(F.col("category_name")).alias("icon"),
    )
