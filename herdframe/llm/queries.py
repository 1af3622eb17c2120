"""The registered queries of the subpackage and, where SQL can say it, the same in DuckDB SQL."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from herdframe.llm import decontaminate, fingerprints, jaccard_join, language_id, lattice, line_dedup, merkle, near_dedup, negatives, pieces, substring_dedup, token_counts, warc
from herdframe.llm.common import scratch, table, whole
from herdframe.llm.repeats import NULL_ID


def op1_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = scratch(spark, "warc")
    warc.write(pages.select(F.col("page_id").alias("id"), "url", F.col("html").cast("binary").alias("payload")), path)
    read = warc.read(spark, path)
    return read.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fingerprints.edited_pairs(table(spark, sf_dir, "documents"))
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        fingerprints.likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        fingerprints.likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that lose sentences."""
    spans = substring_dedup.deduped_spans(table(spark, sf_dir, "documents"))
    return spans.where("n_removed > 0").select("doc_id", "n_sentences", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", whole("text").alias("text"))
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = docs.select("doc_id", pieces.coded(docs, model).alias("coded"))
    return coded.select(
        "doc_id",
        F.size("coded.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("coded.ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("coded.text"), 256).alias("decoded_sha256"),
    )


def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, with the item."""
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_edits", "first_byte", "end_byte")


def bucket(mod: int) -> Column:
    """crc32 of doc_id as text, modulo mod; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (bucket(3) == 1).alias("held_out"))
    model = language_id.fit(docs.where(~F.col("held_out")))
    found = language_id.predict(docs.select("doc_id", "text", "held_out"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", whole("text").alias("text"))
    n = token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    counted = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), n.alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op8_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = lattice.scored(docs, public_tokenizers.path("piece_bpe_32k.model"), bucket(7) != 2, learn=True)
    return scores.withColumn("held_out", bucket(7) == 2)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_dedup.deduped_lines(table(spark, sf_dir, "documents"))
    return lines.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.joined(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of all documents, and what root each proof gives if some texts lose their line feeds."""
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars"]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    leaf, other = (merkle.digest(*[F.col(c) for c in fields], t) for t in (F.col("text"), F.translate("text", "\n", "")))
    leaves = docs.select("doc_id", "source", leaf.alias("leaf"), F.when(tampered, other).alias("tampered"))
    found = merkle.manifest(leaves, "source", "doc_id", "leaf", ("tampered",))
    now = found.withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), "path"))
    return now.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest("path").alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth row is an anchor; every seventh has another label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc_bundles, op2_fingerprints, op3_substring_dedup, op4_piece_encoding, op5_benchmark_leaks, op6_language_id, op7_token_counts, op8_lattice_scores, op9_near_dedup, op10_line_dedup, op11_jaccard_join, op12_merkle_manifest, op13_hard_negatives)}


OP1_SQL = f"""
with p as (select page_id, coalesce(html, '') as html from pages),
k as (select page_id, html, strlen(html) as n, min(page_id) over (partition by html) as first_id, count(*) over (partition by html) as copies from p)
select page_id, n::bigint as payload_bytes, sha256(html) as payload_digest,
  case when n >= {warc.REVISIT} and copies > 1 and first_id is not null and page_id is distinct from first_id then 'revisit' else 'response' end as record_type,
  case when n >= {warc.REVISIT} and copies > 1 and page_id is distinct from first_id then first_id end as refers_to
from k
"""


def _components_sql(percent: int) -> str:
    """doc_id, n_shingles, component_id: rows of one id are linked through it, and a null id is linked with nothing."""
    width = near_dedup.WIDTH
    return f"""
with recursive d as (select row_number() over () as no, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
w as (select no, doc_id, unnest(w) as w, generate_subscripts(w, 1) as pos, len(w) as many from (select no, doc_id, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w from d)),
p as (select no, doc_id, many, concat_ws(' ', {", ".join(f"lead(w, {k}) over v" if k else "w" for k in range(width))}) as g, lead(w, {width - 1}) over v as last, pos from w window v as (partition by no order by pos)),
s as (select distinct no, doc_id, g from p where last is not null or (many < {width} and pos = 1)),
n as (select no, doc_id, count(*) as n from s group by all),
i as (select a.no as a, b.no as b, count(*) as shared from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (select distinct x.doc_id as a, y.doc_id as b from i join n x on x.no = a join n y on y.no = b where 100 * shared >= {percent} * (x.n + y.n - shared)),
l as (select a, b from e union select b, a from e),
r as (select a, b from l union select r.a, l.b from r join l on l.a = r.b),
c as (select a as doc_id, least(a, min(b)) as component_id from r group by a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(c.component_id, d.doc_id) as component_id
from d left join n using (no) left join c on c.doc_id = d.doc_id
"""


OP9_SQL = f"select *, coalesce(component_id = doc_id, true) as kept from ({_components_sql(near_dedup.PERCENT)})"
OP11_SQL = _components_sql(jaccard_join.PERCENT)


# a null id counts as the smallest, and rows of one id are one document with a row each
OP10_SQL = f"""
with d as (select row_number() over () as no, doc_id, coalesce(doc_id, {NULL_ID}) as id, coalesce(text, '') as text from documents),
l as (select no, doc_id, id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from d),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
r as (select key, min(id) as first_id from k where length(key) >= {line_dedup.SHORTEST} group by key having count(distinct id) > 1),
m as (select k.*, r.first_id is not null and r.first_id <> k.id as gone from k left join r using (key))
select doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from m group by no, doc_id
"""


# crc32 by its table of 256 numbers; a run of nodes is pos // 3, and a level ends where one node is left
_CRC = "list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)))"


def _tree(name: str, leaves: str) -> str:
    """CTE (tree, level, pos, n, h) of all nodes over leaves (tree, pos, n, h)."""
    return f"""{name} as (select tree, 0 as level, pos, n, h from {leaves}
  union all select tree, level + 1, pos // {merkle.RUN}, any_value(n + {merkle.RUN - 1}) // {merkle.RUN}, sha256(string_agg(h, '' order by pos)) from {name} where n > 1 group by tree, level, pos // {merkle.RUN})"""


def _sides(name: str, nodes: str) -> str:
    """CTE (tree, level, pos, l, r): what lies left and right of each node in its run."""
    w = f"over (partition by tree, level, pos // {merkle.RUN} order by pos rows between"
    return f"""{name} as (select tree, level, pos, coalesce(string_agg(h, '') {w} unbounded preceding and 1 preceding), '') as l, coalesce(string_agg(h, '') {w} 1 following and unbounded following), '') as r from {nodes} where n > 1)"""


def _field(c: str) -> str:
    return f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"


_HEAD = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
OP12_SQL = f"""
with recursive crc as (select {_CRC} as tab),
d as (select doc_id, source, sha256({_HEAD} || {_field("text")}) as leaf,
  case when doc_id is not null and xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::varchar, ''), lambda x: ord(x))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 2 = 0
    then sha256({_HEAD} || {_field("replace(text, chr(10), '')")}) end as tampered from documents, crc),
p as (select *, row_number() over () as no, row_number() over w - 1 as pos, count(*) over (partition by source) as n, coalesce('=' || source, '') as tree from d window w as (partition by source order by doc_id nulls first, leaf)),
p0 as (select tree, pos, n, leaf as h from p),
{_tree("t", "p0")},
sub as (select tree, h as subroot from t where n = 1),
q0 as (select '' as tree, tree as source, row_number() over (order by tree) - 1 as pos, count(*) over () as n, subroot as h from sub),
{_tree("u", "q0")},
{_sides("ts", "t")}, {_sides("us", "u")},
k as (select 1 + coalesce(max(level), -1) as most from ts),
steps as (select no, level, l, r from p join ts on ts.tree = p.tree and ts.pos = p.pos // ({merkle.RUN} ** level)::bigint
  union all select no, most + level, l, r from p cross join k join q0 on q0.source = p.tree join us on us.pos = q0.pos // ({merkle.RUN} ** level)::bigint),
o as (select no, l, r, row_number() over (partition by no order by level) as k from steps),
f as (select no, 0::bigint as k, coalesce(tampered, leaf) as h from p union all select f.no, f.k + 1, sha256(l || h || r) from f join o on o.no = f.no and o.k = f.k + 1),
g as (select no, arg_max(h, k) as folded_root from f group by no),
s as (select no, sha256(string_agg(l || r, '' order by k)) as proof from o group by no)
select doc_id, leaf, subroot, u.h as root, coalesce(proof, sha256('')) as proof_sha256, folded_root, folded_root = u.h as verified
from p join sub using (tree) join g using (no) left join s using (no) cross join (select h from u where n = 1) u
"""

_TOP = "order by score desc, vec_id"
OP13_SQL = f"""
with r as (select row_number() over () as no, vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint as label, list_transform(embedding, lambda x: floor({negatives.SCALE} * x::double)) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
m as (select a.no, a.vec_id as anchor_id, r.vec_id, r.label = a.label as same, list_inner_product(a.v, r.v)::bigint as score from r a join r on a.vec_id % 100 = 0 and (r.label <> a.label or r.vec_id <> a.vec_id)),
p as (select no, row_number() over (partition by no {_TOP}) as p, vec_id as positive_id, score as positive_score from m where same qualify p <= {negatives.POSITIVES}),
n as (select m.anchor_id, positive_id, row_number() over (partition by no, p {_TOP}) as rank, m.vec_id as negative_id, positive_score, m.score as negative_score
  from p join m using (no) where not same and {negatives.LOW} * positive_score <= 100 * m.score and m.score <= positive_score qualify rank <= {negatives.NEGATIVES})
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_bundles": OP1_SQL, "op9_near_dedup": OP9_SQL, "op10_line_dedup": OP10_SQL, "op11_jaccard_join": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_hard_negatives": OP13_SQL}
