"""Removal of repeated multi-line passages, by two rules.

``report`` (the query, whose SQL fixes its rule) cuts chunks whose bounds follow the content: a line is hashed; a rolling
hash over it and the line before closes a chunk where it falls in one of ``spacing`` classes. Chunks of at least two lines
that are not blank are grouped over the whole corpus by digest and by text: the grouping compares bytes, and a digest that
stands for two texts removes nothing. Of a repeated chunk the copy in the document with the smallest ``doc_id`` stays (its
first one there); the others go. A bound hangs on the line before it, so a chunk at the edge of a passage merges with
foreign lines, and repeats of fewer lines than a chunk are missed.

``dedup`` (the pipeline's stage) has no bounds to miss: each two successive lines that are not blank, with the blank ones
between them, are a piece, and so is a line of ``WORDS`` words or more. A piece that stands in a document with a smaller
``doc_id``, or before in the same text, loses its lines, so of every repeated run of two lines the later copies go whole;
each line's first copy stays. Pieces with equal SHA-256 are taken as equal.

Null texts stay null and have no lines. Rows with a null ``doc_id`` lose only what repeats within themselves. Rows
that share a ``doc_id`` are one document and keep alike. Very long texts are worked off whole, in steps that grow with
their lines (times a logarithm, for sorting digests). Other columns are kept by ``dedup``; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, own, read

SPACING = 3
#: A single line of so many words is a passage.
WORDS = 50

#: Each array is bound to a name by a one-element transform, so that it is computed once a row.
_CHUNKS = r"""
transform(array(split(text, '\n')), lines ->
  transform(array(transform(lines, line -> cast(conv(substr(md5(line), 1, 8), 16, 10) as bigint))), hash ->
    transform(array(filter(sequence(1, size(hash)), i -> i = size(hash) or (hash[i - 1] + 31 * coalesce(get(hash, i - 2), 0)) % {spacing} = 0)), ends ->
      transform(sequence(1, size(ends)), k -> slice(lines, coalesce(get(ends, k - 2), 0) + 1, ends[k - 1] - coalesce(get(ends, k - 2), 0)))
    )[0]
  )[0]
)[0]"""
_MARKED = "transform({chunks}, c -> struct(array_join(c, '\n') as body, size(c) as n, size(filter(c, line -> trim(line) <> '')) >= 2 as long))"
#: Chunks that stay. The digests of removed chunks (as number 0) and those of the text's own are sorted together: a long
#: chunk goes where its predecessor is a mark of its digest or has the same text, whatever the number of chunks.
_KEPT = """
transform(array({marked}), all -> transform(array(sort_array(concat(
    transform(gone, g -> struct(g as digest, '' as body, 0 as k)),
    filter(transform(all, (c, i) -> struct(if(c.long, md5(c.body), null) as digest, c.body as body, i + 1 as k)), s -> s.digest is not null)))), sorted ->
  transform(array_except(sequence(1, size(all)), transform(
    filter(sorted, (s, m) -> s.k > 0 and m > 0 and sorted[m - 1].digest = s.digest and (sorted[m - 1].k = 0 or sorted[m - 1].body = s.body)), s -> s.k)), k -> all[k - 1])
)[0])[0]"""


def _marked(spacing: int) -> str:
    return _MARKED.format(chunks=_CHUNKS.format(spacing=spacing))


def removed(docs: DataFrame, spacing: int = SPACING) -> DataFrame:
    """(doc_id, gone): digests of the chunks each document loses to a document with a smaller id."""
    rows = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    found = rows.select("doc_id", F.explode(F.expr(f"filter({_marked(spacing)}, c -> c.long)")).alias("c")).select("doc_id", F.md5("c.body").alias("digest"), F.col("c.body").alias("body"))
    texts = found.groupBy("digest", "body").agg(F.min("doc_id").alias("keeper"), F.count("*").alias("n"))
    repeated = texts.groupBy("digest").agg(F.count("*").alias("texts"), F.max("n").alias("n"), F.min("keeper").alias("keeper")).where("texts = 1 and n > 1")
    lost = found.select("doc_id", "digest").distinct().join(repeated.select("digest", "keeper"), "digest").where("doc_id <> keeper")
    return lost.groupBy("doc_id").agg(F.collect_list("digest").alias("gone"))


#: Of each text: its lines, and its pieces as (first line, last line, digest).
_PIECES = rf"""
transform(array(split(text, '\n')), lines ->
  transform(array(filter(sequence(1, size(lines)), i -> trim(lines[i - 1]) <> '')), full -> struct(lines as lines, concat(
    transform(filter(sequence(1, size(full)), k -> k < size(full)), k -> struct(full[k - 1] as i, full[k] as j,
      unhex(sha2(array_join(slice(lines, full[k - 1], full[k] - full[k - 1] + 1), '\n'), 256)) as digest)),
    transform(filter(full, i -> length(lines[i - 1]) >= {2 * WORDS - 1} and size(filter(split(lines[i - 1], '[ \t\r]+'), word -> word <> '')) >= {WORDS}), i -> struct(i as i, i as j,
      unhex(sha2(lines[i - 1], 256)) as digest))
  ) as pieces))[0]
)[0]"""
#: Lines outside the pieces that are lost to another document (as number 0) or stood before in the same text: those whose
#: predecessor among the sorted digests is the same.
_LEFT = f"""
transform(array({_PIECES}), own -> transform(array(sort_array(concat(
    transform(gone, g -> struct(g as digest, 0 as k)), transform(own.pieces, (p, k) -> struct(p.digest as digest, k + 1 as k))))), sorted ->
  transform(array_except(sequence(1, size(own.lines)), flatten(transform(
    filter(sorted, (s, m) -> s.k > 0 and m > 0 and sorted[m - 1].digest = s.digest), s -> sequence(own.pieces[s.k - 1].i, own.pieces[s.k - 1].j)))), i -> own.lines[i - 1])
)[0])[0]"""


#: A text's digests, each once.
_DIGESTS = f"transform(array(sort_array(transform({_PIECES}.pieces, p -> p.digest))), sorted -> filter(sorted, (d, m) -> m = 0 or sorted[m - 1] <> d))[0]"


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, gone): digests of the pieces each document loses to a document with a smaller id."""
    rows = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    found = rows.select("doc_id", F.explode(F.expr(_DIGESTS)).alias("digest"))
    keepers = found.groupBy("digest").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last")).where("keeper <> last").drop("last")
    lost = found.join(keepers, "digest").where("doc_id <> keeper")
    return lost.groupBy("doc_id").agg(F.collect_set("digest").alias("gone"))


def dedup(docs: DataFrame) -> DataFrame:
    """The documents without later copies of repeated runs; ``n_chars`` follows the text where the column exists."""
    id_name, gone = free_name(docs, "id"), free_name(docs, "gone")
    marks = repeats(docs).select(F.col("doc_id").alias(id_name), F.col("gone").alias(gone))
    joined = docs.join(marks, docs["doc_id"] == F.col(id_name), "left")
    left = _LEFT.replace("gone", f"coalesce({gone}, array())")
    out = joined.withColumn("text", F.when(F.col("text").isNotNull(), F.array_join(F.expr(left), "\n")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns)


def report(docs: DataFrame, spacing: int = SPACING) -> DataFrame:
    """(doc_id, n_lines, n_chunks, n_removed_lines, kept_md5) for every row."""
    marks = removed(docs, spacing).select(F.col("doc_id").alias("_id"), "gone")
    joined = own(docs, "doc_id", "text").join(marks, F.col("doc_id") == F.col("_id"), "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<string>")))
    marked = _marked(spacing)
    sums = f"""transform(array({marked}), every -> transform(array({_KEPT.format(marked="every")}), kept -> struct(
        aggregate(every, 0L, (n, c) -> n + c.n) as n_lines, cast(size(every) as bigint) as n_chunks,
        aggregate(every, 0L, (n, c) -> n + c.n) - aggregate(kept, 0L, (n, c) -> n + c.n) as n_removed_lines,
        md5(array_join(transform(kept, c -> c.body), '\n')) as kept_md5))[0])[0]"""
    out = joined.select("doc_id", F.expr(sums).alias("x"))
    zero = F.lit(0).cast("long")
    return out.select("doc_id", *(F.coalesce(f"x.{c}", zero).alias(c) for c in ("n_lines", "n_chunks", "n_removed_lines")), "x.kept_md5")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(read(spark, sf_dir, "documents"))


ORACLE = rf"""
with lines as (
  select doc_id, text is null as missing, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i, len(string_split(text, chr(10))) as n
  from documents where text is not null
), hashed as (
  select *, cast('0x' || substr(md5(line), 1, 8) as bigint) as h from lines
), closed as (
  select *, (i = n or (h + 31 * coalesce(lag(h) over (partition by doc_id order by i), 0)) % {SPACING} = 0) as ends from hashed
), numbered as (
  select *, coalesce(sum(cast(ends as int)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as k from closed
), chunks as (
  select doc_id, k, string_agg(line, chr(10) order by i) as body, count(*) as n, count(*) filter (where trim(line, ' ') <> '') >= 2 as long from numbered group by doc_id, k
), firsts as (
  select body, min(doc_id) as keeper from chunks where long group by body
), judged as (
  select c.*, c.long and (c.doc_id <> f.keeper or c.k > min(c.k) over (partition by c.doc_id, c.body)) as gone
  from chunks c left join firsts f on c.body = f.body and c.long
)
select d.doc_id, coalesce(cast(sum(j.n) as bigint), 0) as n_lines, count(j.k) as n_chunks,
  coalesce(cast(sum(case when j.gone then j.n else 0 end) as bigint), 0) as n_removed_lines,
  case when d.text is not null then md5(coalesce(string_agg(j.body, chr(10) order by j.k) filter (where not j.gone), '')) end as kept_md5
from documents d left join judged j on d.doc_id = j.doc_id group by d.doc_id, d.text
"""
