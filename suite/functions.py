"""The scalar functions, by their published names, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions.registry import call
from suite.registry import query


def _round(df, digits=9, keep=("id",)):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


@query("""
select id, round(abs(x), 9) as abs, round(abs(value), 9) as abs_4, round(acos(y / 90), 9) as acos, round(asin(y / 90), 9) as asin,
  round(atan(x), 9) as atan, round(atan2(y, x), 9) as atan2, round(cos(x), 9) as cos, round(sin(x), 9) as sin,
  round(tan(y / 60), 9) as tan, cast(ceil(x) as bigint) as ceil, cast(floor(x) as bigint) as floor, round(exp(y / 30), 9) as exp, round(sqrt(abs(x)), 9) as sqrt,
  round(pi(), 9) as pi, round(ln(abs(x) + 1), 9) as log, round(pow(abs(y), 1.5), 6) as pow, round_even(x * 2, 0) as rint,
  cast(floor(x * 2 + 0.5) as bigint) as round, cast(floor(x * 2 + 0.5) as bigint) as round_2, cast(floor(value + 0.5) as bigint) as roundDouble,
  round(x - 7 * round_even(x / 7, 0), 9) as IEEEremainder, (id * 31 - 5000) % 7 as modulo,
  case when id % 3 <> 0 then greatest(x, y) end as max, greatest(x, y) as max_4,
  case when id % 3 <> 0 then least(x, y) end as min, least(x, y) as min_2,
  round(degrees(x), 9) as toDegrees, round(radians(x), 9) as toRadians
from f_points""")
def fn_math(t):
    p = t("f_points")
    x, y, v, i = F.col("x"), F.col("y"), F.col("value"), F.col("id")
    maybe = F.when(i % 3 != 0, y)
    out = p.select(
        "id", call("abs", x).alias("abs"), call("abs_4", v).alias("abs_4"), call("acos", y / 90).alias("acos"),
        call("asin", y / 90).alias("asin"), call("atan", x).alias("atan"), call("atan2", y, x).alias("atan2"),
        call("cos", x).alias("cos"), call("sin", x).alias("sin"), call("tan", y / 60).alias("tan"),
        call("ceil", x).alias("ceil"), call("floor", x).alias("floor"), call("exp", y / 30).alias("exp"),
        call("sqrt", F.abs(x)).alias("sqrt"), call("pi").alias("pi"), call("log", F.abs(x) + 1).alias("log"),
        F.round(call("pow", F.abs(y), F.lit(1.5)), 6).alias("pow"), call("rint", x * 2).alias("rint"),
        call("round", x * 2).alias("round"), call("round_2", x * 2).alias("round_2"),
        call("roundDouble", v).alias("roundDouble"), call("IEEEremainder", x, 7).alias("IEEEremainder"),
        call("modulo", i * 31 - 5000, 7).alias("modulo"), call("max", x, maybe).alias("max"),
        call("max_4", x, y).alias("max_4"), call("min", x, maybe).alias("min"), call("min_2", x, y).alias("min_2"),
        call("toDegrees", x).alias("toDegrees"), call("toRadians", x).alias("toRadians"))
    return _round(out)


@query()
def fn_random(t):
    return t("f_points").select("id", call("random", 7).alias("random"))


@query("""
select id, x = y as equalTo, x <> y as notEqualTo, x > y as greaterThan, x >= y as greaterEqualThan, x < y as lessThan,
  x <= y as lessEqualThan, x between -10 and y as between_, id % 10 in (1, 3) as in2, id % 10 in (1, 2, 3, 4) as in4,
  id % 20 in (1,2,3,4,5,6,7,8,9,10) as in10, id % 7 in (1,2,3) as "in", regexp_full_match(locator, 'ds-1.') as isLike,
  id % 3 = 0 as isNull, not (x > y) as "not", case when x > y then 'a' else 'b' end as if_then_else, true as has_x, false as has_z,
  true as isInstanceOf
from f_points""")
def fn_comparison(t):
    p = t("f_points")
    x, y, i = F.col("x"), F.col("y"), F.col("id")
    return p.select(
        "id", *[call(n, x, y).alias(n) for n in ("equalTo", "notEqualTo", "greaterThan", "greaterEqualThan", "lessThan", "lessEqualThan")],
        call("between", x, -10, y).alias("between_"), call("in2", i % 10, 1, 3).alias("in2"),
        call("in4", i % 10, 1, 2, 3, 4).alias("in4"), call("in10", i % 20, *range(1, 11)).alias("in10"),
        call("in", i % 7, 1, 2, 3).alias("in"), call("isLike", F.col("locator"), "ds-1.").alias("isLike"),
        call("isNull", F.when(i % 3 != 0, x)).alias("isNull"), call("not", x > y).alias("not"),
        call("if_then_else", x > y, "a", "b").alias("if_then_else"), call("PropertyExists", p, "x").alias("has_x"),
        call("PropertyExists", p, "z").alias("has_z"), call("isInstanceOf", x, "double").alias("isInstanceOf"))


@query("""
select id, try_cast(txt as double) as convert, txt not in ('0', 'f', '') as parseBoolean, try_cast(txt as double) as parseDouble,
  cast(trunc(try_cast(txt as double)) as int) as parseInt, cast(trunc(try_cast(txt as double)) as bigint) as parseLong, id % 3 <> 0 as double2bool,
  id % 5 <> 0 as int2bbool, cast(id as double) as int2ddouble, format('{:,.1f}', value * 100) as numberFormat,
  replace(replace(replace(replace(format('{:,.2f}', value * 100), ',', '_'), '.', ','), '_', '.'), '-', '~') as numberFormat2,
  strftime(ts, '%Y/%m/%d %H') as dateFormat, strftime(ts, '%Y-%m-%d %H:%M:%S') as dateParse
from (select *, case id % 5 when 0 then '0' when 1 then 'f' when 2 then '' when 3 then cast(value as varchar) else 'abc' end as txt from f_points)""")
def fn_conversion(t):
    i = F.col("id")
    p = t("f_points").withColumn("txt", F.when(i % 5 == 0, "0").when(i % 5 == 1, "f").when(i % 5 == 2, "").when(
        i % 5 == 3, F.col("value").cast("string")).otherwise("abc"))
    txt = F.col("txt")
    return p.select(
        "id", call("convert", txt, "double").alias("convert"), call("parseBoolean", txt).alias("parseBoolean"),
        call("parseDouble", txt).alias("parseDouble"), call("parseInt", txt).alias("parseInt"),
        call("parseLong", txt).alias("parseLong"), call("double2bool", (i % 3).cast("double")).alias("double2bool"),
        call("int2bbool", i % 5).alias("int2bbool"), call("int2ddouble", i).alias("int2ddouble"),
        call("numberFormat", "#,##0.0", F.col("value") * 100).alias("numberFormat"),
        call("numberFormat2", "#,##0.00", F.col("value") * 100, "~", ",", ".").alias("numberFormat2"),
        call("dateFormat", "yyyy/MM/dd HH", F.col("ts")).alias("dateFormat"),
        F.date_format(call("dateParse", "yyyyMMdd'T'HHmmss", F.date_format("ts", "yyyyMMdd'T'HHmmss")),
                      "yyyy-MM-dd HH:mm:ss").alias("dateParse"))


@query("""
select id, concat(name, '/', locator) as Concatenate, concat(name, locator) as strConcat, length(name) as length,
  length(body) as strLength, concat(upper(name[1]), lower(name[2:])) as strCapitalize, ends_with(name, '1.dat') as strEndsWith,
  starts_with(name, 'src1') as strStartsWith, lower(name) = lower(locator) as strEqualsIgnoreCase,
  strpos(body, 'er') - 1 as strIndexOf,
  case when strpos(body, 'er') = 0 then -1 else length(body) - strpos(reverse(body), 're') - 1 end as strLastIndexOf,
  regexp_full_match(name, '.*_en_.*') as strMatches, strpos(name, '_') as strPosition,
  length(name) - strpos(reverse(name), '_') + 1 as strPositionBack,
  md5(regexp_replace(body, '[aeiou]+', '*', 'g')) as strReplace, regexp_replace(name, '_', '-') as strReplaceFirst,
  substr(name, 3, 4) as strSubstring, substr(name, 5) as strSubstringStart, md5(lower(body)) as strToLowerCase,
  md5(upper(name)) as strToUpperCase, trim(concat('  ', name, ' ')) as strTrim, ltrim(concat('xx', name, 'xx'), 'x') as strTrim2,
  concat(regexp_extract(name, '_([a-z]+)_([0-9]+)', 2), ':', regexp_extract(name, '_([a-z]+)_([0-9]+)', 1)) as stringTemplate
from (select m.*, d.text as body from f_metadata m join documents d on d.doc_id = m.id)""")
def fn_strings(t):
    p = t("f_metadata").join(t("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body")), "id")
    n, b, loc = F.col("name"), F.col("body"), F.col("locator")
    return p.select(
        "id", call("Concatenate", n, "/", loc).alias("Concatenate"), call("strConcat", n, loc).alias("strConcat"),
        call("length", n).alias("length"), call("strLength", b).alias("strLength"),
        call("strCapitalize", n).alias("strCapitalize"), call("strEndsWith", n, F.lit("1.dat")).alias("strEndsWith"),
        call("strStartsWith", n, F.lit("src1")).alias("strStartsWith"),
        call("strEqualsIgnoreCase", n, loc).alias("strEqualsIgnoreCase"), call("strIndexOf", b, "er").alias("strIndexOf"),
        call("strLastIndexOf", b, "er").alias("strLastIndexOf"), call("strMatches", n, ".*_en_.*").alias("strMatches"),
        call("strPosition", "_", n).alias("strPosition"), call("strPosition", "_", n, "backToFront").alias("strPositionBack"),
        F.md5(call("strReplace", b, "[aeiou]+", "*")).alias("strReplace"),
        call("strReplace", n, "_", "-", False).alias("strReplaceFirst"), call("strSubstring", n, 2, 6).alias("strSubstring"),
        call("strSubstringStart", n, 4).alias("strSubstringStart"), F.md5(call("strToLowerCase", b)).alias("strToLowerCase"),
        F.md5(call("strToUpperCase", n)).alias("strToUpperCase"),
        call("strTrim", F.concat(F.lit("  "), n, F.lit(" "))).alias("strTrim"),
        call("strTrim2", F.concat(F.lit("xx"), n, F.lit("xx")), "leading", "x").alias("strTrim2"),
        call("stringTemplate", n, "_([a-z]+)_([0-9]+)", "${2}:${1}").alias("stringTemplate"))


@query("""
select id, case when value >= 100 then 'high' when value >= 20 then 'mid' else 'low' end as Categorize,
  case when value > 100 then 'high' when value > 20 then 'mid' else 'low' end as CategorizePreceding,
  case id % 4 when 0 then 'zero' when 1 then 'one' when 2 then 'two' end as Recode,
  round(case when value < 0 then 0 when value < 50 then value / 50 * 10 when value < 100 then 10 + (value - 50) / 50 * 90 else 100 end, 9) as Interpolate,
  round(case when value < 0 then 5 when value < 100 then 5 + (1 - cos(value / 100 * pi())) * 0.5 * 10 else 15 end, 9) as InterpolateCosine,
  x as property, concat('[', x, ',', y, ']') as list, concat('{"id":', id, ',"x":', x, '}') as Feature
from f_points""")
def fn_values(t):
    v, i = F.col("value"), F.col("id")
    return t("f_points").select(
        "id", call("Categorize", v, "low", 20, "mid", 100, "high").alias("Categorize"),
        call("Categorize", v, "low", 20, "mid", 100, "high", boundary="preceding").alias("CategorizePreceding"),
        call("Recode", i % 4, 0, "zero", 1, "one", 2, "two").alias("Recode"),
        F.round(call("Interpolate", v, 0, 0, 50, 10, 100, 100), 9).alias("Interpolate"),
        F.round(call("Interpolate", v, 0, 5, 100, 15, method="cosine"), 9).alias("InterpolateCosine"),
        call("property", "x").alias("property"), F.to_json(call("list", F.col("x"), F.col("y"))).alias("list"),
        F.to_json(call("Feature", call("id"), call("property", "x"))).alias("Feature"))
