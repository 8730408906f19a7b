"""One registered query for each operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from geoloom.llm.alignment import aligned_tokens
from geoloom.llm.decontamination import EVIDENCE, leaks
from geoloom.llm.html_text import extract_text
from geoloom.llm.jaccard import jaccard_groups
from geoloom.llm.licenses import scan_licenses
from geoloom.llm.line_dedup import deduplicated
from geoloom.llm.packing import pack
from geoloom.llm.quality_classifier import score, train
from geoloom.llm.quality_rules import quality_rules
from geoloom.llm.records import token_records
from geoloom.llm.token_counts import token_counts
from geoloom.llm.url_filters import DOMAIN, HOST, PATH, URL, bare_url, filter_urls
from geoloom.llm.whitening import whitened
from geoloom.session import ship_package

QUERIES = {}
ORACLE = {}
BYTE_BPE, WORD_BPE, PIECES = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def ready(spark: SparkSession) -> SparkSession:
    """The package sent to executors, and batches of whole texts small enough for a Python worker of modest size."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return ship_package(spark)


def query(oracle: str | None = None):
    """Register a function of (read a table by name) under its own name."""
    def register(fn):
        def run(spark: SparkSession, sf_dir: str):
            ready(spark)
            return fn(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        QUERIES[fn.__name__] = run
        if oracle:
            ORACLE[fn.__name__] = oracle
        return fn
    return register


def trusted(labels):
    return labels.filter("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")


# Every page is a capture, fetched on a day of 2024 by its id, and gives one dated edit of a list, of a pattern of its own URL.
BARE = r"regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '[?#].*$', '')"


@query(rf"""
with bare as (select *, {BARE} as rest from pages),
hosts as (select page_id, url, lower(regexp_extract(rest, '^(?:[^/@]*@)?([^/:]*)', 1)) as host, regexp_extract(rest, '^[^/]*(/.*)$', 1) as path,
    date '2024-01-01' + cast(page_id * 37 % 365 as int) as fetched from bare),
edits as (select case when page_id % 3 = 0 then 'allow' else 'block' end as list, 1 + page_id % 4 as kind,
    case page_id % 4 when 3 then host || path when 2 then host || '/' || split_part(path, '/', 2) || '/' when 1 then host
      else regexp_extract(host, '[^.]*\.[^.]*$') end as pattern,
    case when page_id * 7 % 5 < 2 then 'remove' else 'add' end as action, date '2024-01-01' + cast(page_id * 53 % 365 as int) as day, page_id as seq from hosts),
daily as (select list, kind, pattern, day, arg_max(action, seq) as action from edits group by all),
spans as (select *, lead(day, 1, date '9999-12-31') over (partition by list, kind, pattern order by day) as to_day,
    lag(action) over (partition by list, kind, pattern order by day) as was from daily),
-- an add after an add changes nothing: `since` is the first day of the run
runs as (select *, max(case when action = 'add' and was is distinct from 'add' then day end) over (partition by list, kind, pattern order by day) as since
    from spans),
active as (select list, kind, pattern, since, day, to_day from runs where action = 'add'),
met as (select h.page_id, h.url, h.fetched, a.list, a.kind, a.pattern, a.since, row_number() over (partition by h.page_id
      order by a.kind desc, a.list = 'allow' desc, length(a.pattern) desc, a.list desc, a.pattern desc, a.since desc) as place
    from hosts h left join active a on a.day <= h.fetched and h.fetched < a.to_day and case a.kind when 4 then h.host || h.path = a.pattern
      when 3 then starts_with(h.host || h.path, a.pattern) when 2 then h.host = a.pattern else h.host = a.pattern or ends_with(h.host, '.' || a.pattern) end)
select page_id, url, strftime(fetched, '%Y-%m-%d') as fetched, coalesce(list = 'allow', true) as kept, list, cast(kind as int) as kind, pattern,
  strftime(since, '%Y-%m-%d') as since from met where place = 1""")
def op1_url_filters(table):
    day = lambda by: F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * by % 365).cast("int"))
    pages = table("pages").select("page_id", "url")
    bare, host = bare_url(F.col("url")), F.element_at(F.split(bare_url(F.col("url")), "/"), 1)
    kind = (1 + F.col("page_id") % 4).cast("int")
    edits = pages.select(
        F.when(F.col("page_id") % 3 == 0, "allow").otherwise("block").alias("list"), kind.alias("kind"),
        F.when(kind == URL, bare).when(kind == PATH, F.concat(host, F.lit("/"), F.coalesce(F.get(F.split(bare, "/"), F.lit(1)), F.lit("")), F.lit("/")))
        .when(kind == HOST, host).when(kind == DOMAIN, F.regexp_extract(host, r"[^.]*\.[^.]*$", 0)).alias("pattern"),
        F.when(F.col("page_id") * 7 % 5 < 2, "remove").otherwise("add").alias("action"), day(53).alias("day"), F.col("page_id").alias("seq"))
    found = filter_urls(pages.withColumn("fetched", day(37)), edits)
    return found.withColumns({"fetched": F.col("fetched").cast("string"), "since": F.col("since").cast("string")})


@query()
def op2_license_scan(table):
    return scan_licenses(table("documents"))


@query()
def op3_html_text(table):
    return extract_text(table("pages"))


@query()
def op4_cost_balanced_packing(table):
    return pack(table("documents"), BYTE_BPE)


@query()
def op5_binary_records(table):
    return token_records(table("documents"), BYTE_BPE)


@query()
def op6_quality_rules(table):
    return quality_rules(table("documents"), trusted(table("labels")))


@query(r"""
with recursive words as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
grams as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as g from words),
sizes as (select w.doc_id, count(g) as n from words w left join grams using (doc_id) group by w.doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as n_both from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by all),
near as (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * n_both >= 85 * (x.n + y.n - n_both)),
ways as (select a, b from near union all select b, a from near),
reach as (select doc_id as a, doc_id as b from documents union select r.a, w.b from reach r join ways w on w.a = r.b)
select s.doc_id, s.n as n_shingles, min(r.b) as component_id from sizes s join reach r on r.a = s.doc_id group by all""")
def op7_ngram_jaccard(table):
    return jaccard_groups(table("documents"))


@query()
def op8_token_counts(table):
    return token_counts(table("documents"), WORD_BPE)


@query()
def op9_quality_classifier(table):
    return score(table("documents"), train(table("documents"), table("labels")))


@query()
def op10_benchmark_leaks(table):
    return leaks(table("documents"), table("benchmark"), each_window=True, evidence=EVIDENCE)


@query()
def op11_embedding_whitening(table):
    return whitened(table("embeddings"))


@query(r"""
with lines as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
    from documents),
keyed as (select *, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
shared as (select key, max(doc_id) as keeper from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
judged as (select k.*, s.key is null or k.doc_id = s.keeper as stays from keyed k left join shared s on s.key = k.key)
select doc_id, count(*) as n_lines, count(*) filter (where not stays) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where stays), '')) as kept_sha256 from judged group by doc_id""")
def op12_line_dedup(table):
    return deduplicated(table("documents")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query()
def op13_token_alignment(table):
    return aligned_tokens(table("documents"), BYTE_BPE, PIECES)
