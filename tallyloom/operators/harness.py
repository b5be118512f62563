"""Semi-structured logs: parameters, bodies, ordered steps and markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import rules as R


def parameter_ids(rows: DataFrame, name: str, position: str) -> DataFrame:
    """V4: a row's name, or its position as text."""
    return rows.withColumn("param_id", F.coalesce(F.col(name), F.col(position).cast("string")))


def parameter_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every pair of two parameter sets, which a run's author wrote by hand and are small."""
    return left.crossJoin(right)


def envelope(rows: DataFrame, body: str, transport: Column) -> DataFrame:
    """the code inside the body beside that of the transport; `accepted` needs both to be fine."""
    inner = F.get_json_object(F.col(body), "$.k").try_cast("int")
    return rows.withColumns({"transport": transport, "inner": inner, "accepted": transport.isin(200, 201) & F.coalesce(inner < 50, F.lit(False))})


def steps_text(rows: DataFrame, by: list[str], order: str, text: Column) -> DataFrame:
    """K3: the steps of each group in order, as an HTML list."""
    steps = F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), text.alias("text"))))
    items = F.transform(steps, lambda x: F.concat(F.lit("<li>"), x["text"], F.lit("</li>")))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_steps"), F.concat(F.lit("<ol>"), F.array_join(items, ""), F.lit("</ol>")).alias("html"))


def links(pages: DataFrame, html: str) -> DataFrame:
    """The link targets of a page in document order, with their positions."""
    found = F.regexp_extract_all(F.col(html), F.lit('<a href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", F.posexplode(found).alias("position", "href"))


def scoped(html: Column, tag: str) -> Column:
    """the markup inside the first element of this tag, empty without one."""
    return F.regexp_extract(html, f"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1)


def first_of(*choices: Column) -> Column:
    """the first choice that finds something; empty text is nothing."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in choices])


def request_detail(rows: DataFrame, parts: dict[str, Column]) -> DataFrame:
    """J13."""
    return rows.withColumn("detail", R.detail(parts))
