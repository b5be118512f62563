"""Rules that make one column of others. Each is an expression; none needs a UDF."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

HIGH, DONE, TODO, DOING = "High", "Done", "To-Do", "In-Progress"


def task_id(t: Column) -> Column:
    """TASK- and the number from 100 on."""
    return F.concat(F.lit("TASK-"), (t + 100).cast("string"))


def percent(status: Column, between: Column) -> Column:
    """Done is 1, to do is 0, else the given share, rounded to two digits."""
    return F.when(status == DONE, 1.0).when(status == TODO, 0.0).otherwise(F.round(between, 2))


def end_date(start: Column, days: int = 10) -> Column:
    """J7."""
    return F.date_add(start, days)


def days_left(status: Column, end: Column, as_of: Column) -> Column:
    """0 when done, null without an end, else the days from as_of to the end."""
    return F.when(status == DONE, F.lit(0)).when(end.isNotNull(), F.datediff(end, as_of)).cast("int")


def flag(days: Column, status: Column, priority: Column) -> Column:
    """J4, in this order: overdue, attention, ok. Null days are never overdue."""
    return F.when((days < 0) & (status != DONE), "OVERDUE").when((priority == HIGH) & (status != DONE), "ATTENTION").otherwise("OK")


def colour(status: Column, flag: Column) -> Column:
    """the colour that a row is shown in, null for none."""
    return F.when(status == DONE, "green").when(flag == "OVERDUE", "red")


def share(done: Column, total: Column) -> Column:
    """0 of nothing is 0."""
    return F.when(total == 0, 0.0).otherwise(done / total)


def short_hex(key: Column, prefix: str = "test_", digits: int = 10) -> Column:
    """J9 with a key in the place of chance: equal keys give equal names."""
    return F.concat(F.lit(prefix), F.substring(F.md5(key), 1, digits))


def random_name(prefix: str = "test_", digits: int = 10) -> Column:
    """J9 as it is: new for each row and run."""
    return F.concat(F.lit(prefix), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, digits))


def timed_email(prefix: Column, at: Column, domain: str) -> Column:
    """Prefix, plus sign, whole epoch seconds, domain."""
    return F.concat(prefix, F.lit("+"), F.unix_seconds(at).cast("string"), F.lit(f"@{domain}"))


def summary(text: Column, most: int = 500) -> Column:
    """The dots follow however short the text is; null stays null."""
    return F.concat(F.substring(text, 1, most), F.lit("..."))


def json_or_raw(body: Column, schema: str) -> Column:
    """The body as compact JSON of the schema's fields, or as it is when it is no JSON object."""
    parsed = F.from_json(body, schema)
    return F.when(F.get_json_object(body, "$").isNotNull() & F.ltrim(body).startswith("{"), F.to_json(parsed)).otherwise(body)


def any_json_or_raw(body: Column) -> Column:
    """Any JSON (objects with all their fields, arrays, single values) as compact JSON, else the body as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(body)), body)


def detail(parts: dict[str, Column]) -> Column:
    """A line for each part that is there, in order."""
    return F.concat_ws("\n", *[F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), c.cast("string"))) for name, c in parts.items()])


def title_code(title: Column) -> Column:
    """Mr in any case is 1, all else 2, null too."""
    return F.when(F.lower(title) == "mr", 1).otherwise(2)


def chosen(flags: dict[str, Column]) -> Column:
    """The names of the flags that are true, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in flags.items()]))


def label(labels: Column, name: str) -> Column:
    """The value of the first label of this name, null without one."""
    return F.get(F.filter(labels, lambda x: x["name"] == name), F.lit(0))["value"]


def price(text: Column) -> Column:
    """The number of a price such as "Rs. 500"; null where there is none."""
    return F.regexp_extract(text, r"(\d+(?:\.\d+)?)", 1).try_cast("double")


def has_text(text: Column, term: Column) -> Column:
    """a substring in any case. "men" is in "women"."""
    return F.contains(F.lower(text), F.lower(term))


def contains_all(text: Column, fields: Column) -> Column:
    """F8: every field, as text, is somewhere in the text. Null fields are missing fields."""
    return F.forall(fields, lambda x: F.coalesce(F.contains(text, x.cast("string")), F.lit(False)))


def flags_of(names: list[str], present: list[Column]) -> Column:
    """Bits combined by OR; bit i stands for the i-th name."""
    bits = [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, c) in enumerate(zip(names, present, strict=True))]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def next_light(light: Column) -> Column:
    """The light after this one; null after any other text."""
    return F.when(light == "red", "green").when(light == "green", "yellow").when(light == "yellow", "red")
