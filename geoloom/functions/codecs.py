"""JSON message codecs as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.schemas import MESSAGES, TAGGED, TOPICS, required_fields


def _all_present(record: Column, paths: list[str]) -> Column:
    """True when every dotted path is non-null (a null parent makes its fields null)."""
    def field(path: str) -> Column:
        return reduce(lambda c, part: c[part], path.split("."), record)
    return reduce(lambda a, b: a & b, [field(p).isNotNull() for p in paths], F.lit(True))


def _tagged(record: Column, tag: Column, message: str) -> Column:
    """True when the tag is known and the fields it needs are present."""
    ok = F.lit(False)
    for value, paths in TAGGED[message].items():
        ok = F.when(tag == value, _all_present(record, paths)).otherwise(ok)
    return F.coalesce(ok, F.lit(False))


def _accept(raw: Column, message: str) -> Column:
    """The parsed struct, or null when it lacks a required field."""
    if message == "job_status":
        return _job_status(raw)
    if message == "job_request":
        return _job_request(raw)
    if message == "deploy_status":
        return F.when(_tagged(raw, raw["status"], message), raw)
    return F.when(_all_present(raw, required_fields(message)), raw)


def parse(df: DataFrame, records: dict[str, str], value: str = "value",
          only: dict[str, Column] | None = None) -> DataFrame:
    """Adds a column per entry of `records` (name to message type): the record, or null.

    `only` limits the rows a type is tried on. The raw structs pass through an explode of a
    one-element array, so that filters on the records stay above it and each text is parsed once.
    """
    only = only or {}
    raws = F.struct(*[
        F.when(only.get(name, F.lit(True)), F.from_json(F.col(value).cast("string"), MESSAGES[message])).alias(name)
        for name, message in records.items()])
    return df.select("*", F.explode(F.array(raws)).alias("_raw")).select(
        *df.columns, *[_accept(F.col("_raw")[name], message).alias(name) for name, message in records.items()])


def _job_status(raw: Column) -> Column:
    """Accepts a pending task as flat fields or nested under `task`."""
    flat = F.struct(
        raw["status"].alias("status"), raw["id"].alias("id"),
        F.coalesce(raw["serviceName"], raw["task"]["service"]).alias("serviceName"),
        F.coalesce(raw["params"], raw["task"]["parameters"]).alias("params"),
        raw["node"].alias("node"), raw["progress"].alias("progress"),
        raw["result"].alias("result"), raw["reason"].alias("reason"))
    return F.when(raw.isNotNull() & _tagged(flat, flat["status"], "job_status"), flat)


def _job_request(raw: Column) -> Column:
    """The tag may come as `type` or as `tag`."""
    status = F.when(raw["status"].isNotNull(), _job_status(raw["status"]))
    flat = F.struct(
        F.coalesce(raw["type"], raw["tag"]).alias("type"), raw["id"].alias("id"),
        raw["service"].alias("service"), raw["parameters"].alias("parameters"),
        status.alias("status"))
    return F.when(raw.isNotNull() & _tagged(flat, flat["type"], "job_request"), flat)


def encode(record: Column) -> Column:
    """Compact JSON; absent options are left out."""
    return F.to_json(record)


def encode_columns(df: DataFrame) -> DataFrame:
    """One `value` column holding each row as a message."""
    return df.select(encode(F.struct(*df.columns)).alias("value"))


def decode(df: DataFrame, message: str, value: str = "value", strict: bool = False) -> DataFrame:
    """Adds `record`; with `strict` a bad message is an error, else its record is null."""
    out = parse(df, {"record": message}, value)
    if strict:
        problem = F.concat(F.lit(f"not a valid {message}: "), F.col(value).cast("string"))
        out = out.withColumn("record", F.when(F.col("record").isNull(), F.raise_error(problem))
                             .otherwise(F.col("record")))
    return out


def split_bad(df: DataFrame, message: str, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(good records, quarantined messages with a reason)."""
    seen = decode(df, message, value)
    plain = F.try_parse_json(F.col(value).cast("string")).isNull()
    reason = F.when(F.col(value).isNull(), "no value").when(plain, "not json").otherwise("missing field")
    others = [c for c in df.columns if c != value]
    good = seen.filter(F.col("record").isNotNull()).select(*others, "record.*")
    bad = seen.filter(F.col("record").isNull()).select(*df.columns, reason.alias("reason"))
    return good, bad


def split_metadata(df: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages of the two-type topic: (metadata, geometadata, neither). Metadata is tried first."""
    both = parse(df, {"_m": "metadata", "_g": "geometadata"}, value)
    is_m, is_g = F.col("_m").isNotNull(), F.col("_g").isNotNull()
    others = [c for c in df.columns if c != value]
    return (both.filter(is_m).select(*others, "_m.*"),
            both.filter(~is_m & is_g).select(*others, "_g.*"),
            both.filter(~is_m & ~is_g).select(*df.columns))


def decode_any(df: DataFrame, topic: str = "topic", value: str = "value") -> DataFrame:
    """Readable `body` of mixed-topic messages: the first type that fits, else a hex dump."""
    kinds = list(dict.fromkeys(m for messages in TOPICS.values() for m in messages))
    uses = {m: F.col(topic).isin(*[t for t, ms in TOPICS.items() if m in ms]) for m in kinds}
    seen = parse(df, {f"_{m}": m for m in kinds}, value, {f"_{m}": uses[m] for m in kinds})
    # A type is only parsed on its own topics, so the order of types settles every topic's order.
    body = F.coalesce(*[F.to_json(f"_{m}") for m in kinds], F.hex(F.col(value).cast("binary")))
    return seen.select(*df.columns, body.alias("body"))


def bytes_to_hex(octets: Column) -> Column:
    """Signed bytes to lower-case hex, two digits each."""
    return F.array_join(F.transform(octets, lambda b: F.lpad(
        F.lower(F.hex(b.cast("int").bitwiseAND(F.lit(255)))), 2, "0")), "")


def hex_to_bytes(text: Column) -> Column:
    """Hex digits to an array of signed bytes."""
    pairs = F.filter(F.split(text, r"(?<=\G..)"), lambda p: p != "")
    return F.transform(pairs, lambda p: _signed(F.conv(p, 16, 10)))


def _signed(digits: Column) -> Column:
    number = digits.cast("int")
    return F.when(number > 127, number - 256).otherwise(number).cast("tinyint")


def read_stamp(text: Column) -> Column:
    """`yyyy-mm-dd hh:mm:ss[.f…]` to a timestamp; anything else is null."""
    fits = text.rlike(r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,9})?$")
    return F.when(fits, F.try_to_timestamp(text))


def write_stamp(stamp: Column) -> Column:
    """Seconds, a dot, and the fraction without trailing zeros (at least one digit)."""
    return F.regexp_replace(F.date_format(stamp, "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"(\.\d)(\d*?)0+$", "$1$2")
