"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstream.llm import exact_dedup, html_extract, line_dedup, merkle, packing, pii, quality_mil, quality_rules, secrets, sentence_pieces, simhash, toxicity, whitening
from fieldstream.llm.shared import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def span_list(found: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")


def digests(rows: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """From doc_id and ``found``: the number of base spans of each kind, their digest, and all spans."""
    base = F.filter("found", lambda x: x.base)

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x.base & (x.kind == kind))).cast("long").alias(f"n_{kind}")

    return rows.select("doc_id", *map(count, kinds), F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("found")).alias("spans"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(secrets.secrets(table(spark, sf_dir, "documents")), secrets.KINDS[:3])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pii.detect(table(spark, sf_dir, "documents")), pii.BASE)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op5_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(table(spark, sf_dir, "documents"))


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentence_pieces.encode(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), F.element_at("ends", -1).cast("long").alias("n_bytes"),
        F.sha2(F.concat_ws("|", *(F.array_join(F.col(c).cast("array<string>"), " ") for c in ("begins", "ends"))), 256).alias("spans_sha256"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprints(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents")).drop("copied")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def rules_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the quality rules count, without the verdict of the bands."""
    return op7_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def secrets_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_secrets(spark, sf_dir).select("doc_id", *(f"n_{k}" for k in secrets.KINDS[:3]))


def pii_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_pii(spark, sf_dir).select("doc_id", *(f"n_{k}" for k in pii.BASE))


def whitening_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact part of the whitening: one row for each vector."""
    return op13_whitening(spark, sf_dir).where("component = 1").select("vec_id", "n", "deviation")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it imports the operators beside this module

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_packing, op2_secrets, op3_pii, op4_exact_dedup, op5_quality_mil, op6_html_extract, op7_quality_rules, op8_sentence_pieces, op9_toxicity, op10_simhash, op11_merkle, op12_line_dedup, op13_whitening, pipeline, rules_base_counts, secrets_base_counts, pii_base_counts, whitening_deviations)}


OP4_SQL = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as s from documents)
select doc_id, min(doc_id) over (partition by s) as keep_id, count(*) over (partition by s) as group_size,
       doc_id = min(doc_id) over (partition by s) as kept, sha256(s) as text_sha256
from t
"""



# the checksum that the contract names, bit by bit (3988292384 is its reversed polynomial)
CRC_STEP = "case when j % 8 = 0 then xor(acc, ascii(substr(s, j // 8 + 1, 1))) else acc end"
CRCS_SQL = f"""crcs as (select doc_id, xor(list_reduce(list_prepend(4294967295, range(8 * length(s))), lambda acc, j: xor(({CRC_STEP}) >> 1, (({CRC_STEP}) & 1) * 3988292384)), 4294967295) as crc from (select doc_id, doc_id::varchar as s from documents))"""
OP11_SQL = (
    "with recursive "
    + CRCS_SQL
    + r""",
t as (select doc_id, lang, n_chars, [case when v is null then '-' else strlen(v) || ':' || v end for v in [doc_id::varchar, source, lang]] as head, case when text is null then '-' else strlen(text) || ':' || text end as tail from documents),
leaves as (select doc_id, coalesce('+' || lang, '') as tree, sha256(array_to_string(head, '') || case when n_chars is null then '-' else length(n_chars::varchar) || ':' || n_chars end || tail) as leaf,
    sha256(array_to_string(head, '') || case when n_chars is null then '-' else length((n_chars + (crc % 7 = 0)::int)::varchar) || ':' || (n_chars + (crc % 7 = 0)::int) end || tail) as tampered from t join crcs using (doc_id)),
ranked as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as i from leaves),
nodes as (select 0 as level, tree, i, leaf as digest, count(*) over (partition by tree) as n from ranked
  union all
  select * from (select level + 1, tree, i // 2 as j, sha256(string_agg(digest, '' order by i)), (any_value(n) + 1) // 2 from nodes where n > 1 group by level, tree, i // 2)),
subs as (select tree, digest, row_number() over (order by tree) - 1 as i from nodes where n = 1),
tops as (select 0 as level, i, digest, count(*) over () as n from subs
  union all
  select * from (select level + 1, i // 2 as j, sha256(string_agg(digest, '' order by i)), (any_value(n) + 1) // 2 from tops where n > 1 group by level, i // 2)),
both_trees as (select 0 as part, level, tree, i, digest, n from nodes union all select 1, level, '', i, digest, n from tops),
heights as (select tree, max(level) as height from nodes group by tree),
top_height as (select max(level) as height from tops),
folded as (
  select r.doc_id, r.leaf, r.tampered as node, r.tree, r.i, s.i as top_i, s.digest as subroot, 0 as step, h.height, h.height + t.height as steps, '' as proof from ranked r join subs s using (tree) join heights h using (tree), top_height t
  union all
  select f.doc_id, f.leaf, case when b.digest is null then sha256(f.node) when k % 2 = 1 then sha256(b.digest || f.node) else sha256(f.node || b.digest) end, f.tree, case when f.step < f.height then f.i // 2 else f.i end, case when f.step < f.height then f.top_i else f.top_i // 2 end,
    f.subroot, f.step + 1, f.height, f.steps, f.proof || coalesce(b.digest, '')
  from (select *, case when step < height then i else top_i end as k, (step >= height)::int as part, case when step < height then step else step - height end as level, case when step < height then tree else '' end as in_tree from folded where step < steps) f
  left join both_trees b on b.part = f.part and b.level = f.level and b.tree = f.in_tree and b.i = xor(f.k, 1)),
root as (select digest as root from tops where n = 1)
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, node as folded_root, node = root as verified from folded, root where step = steps
"""
)
OP12_SQL = r"""
with t as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos from documents),
k as (select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from t),
h as (select key, max(doc_id) as last, count(distinct doc_id) as holders from k where length(key) >= 20 group by key),
m as (select k.*, coalesce(holders >= 3 and doc_id <> last, false) as gone from k left join h using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256 from m group by doc_id
"""
DEVIATIONS_SQL = """
with good as (select vec_id, embedding from embeddings where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
entries as (select vec_id, unnest(embedding) as c, generate_subscripts(embedding, 1) as k from good),
x as (select vec_id, k, floor(64 * c::double)::bigint + 1000000 as x from entries),
s as (select k, sum(x) as s, count(*) as n from x group by k)
select vec_id, any_value(n) as n, sum((n * x - s) * (n * x - s))::bigint as deviation from x join s using (k) group by vec_id
"""
RULES_SQL = r"""
with t as (select doc_id, coalesce(text, '') as s from documents),
w as (select doc_id, s, regexp_extract_all(s, '[^\x20\x09-\x0D]+') as words, list_filter(string_split(s, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from t),
windows as (select doc_id, unnest(range(len(words) - 7)) as i, words from w where len(words) > 8),
texts as (select doc_id, i, array_to_string(words[i + 1 : i + 8], ' ') as part from windows),
twice as (select doc_id, i from texts qualify count(*) over (partition by doc_id, part) > 1),
covered as (select doc_id, count(distinct i + k) as n from twice, (select unnest(range(8)) as k) group by doc_id),
counts as (select w.doc_id, len(words)::bigint as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as word_chars,
    (length(s) - length(regexp_replace(s, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words from w left join covered using (doc_id))
select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from counts
"""


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN_NAMES = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))
SECRETS_SQL = f"""
with t as (select doc_id, coalesce(text, '') as s from documents)
select doc_id, len(list_filter(regexp_extract_all(s, '({ASSIGN_NAMES})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6))::bigint as n_assign,
  len(list_filter(regexp_extract_all(s, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20))::bigint as n_access, len(list_filter(regexp_extract_all(s, '[0-9a-f]+'), lambda x: length(x) >= 24))::bigint as n_hex
from t
"""
PII_SQL = r"""
with t as (select doc_id, coalesce(text, '') as s from documents),
found as (select doc_id, regexp_extract_all(s, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') as email, regexp_extract_all(s, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') as ip,
    list_transform(regexp_extract_all(s, '[0-9]([\x20-]?[0-9])+'), lambda x: reverse(regexp_replace(x, '[^0-9]', '', 'g'))) as card, list_transform(regexp_extract_all(s, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) as phone from t),
sized as (select doc_id, email, phone, list_filter(card, lambda x: length(x) between 13 and 19) as card, list_transform(ip, lambda x: list_transform(string_split(x, '.'), lambda p: ltrim(p, '0'))) as ip from found)
select doc_id, len(email)::bigint as n_email, len(list_filter(ip, lambda x: len(list_filter(x, lambda p: length(p) > 3 or coalesce(try_cast(nullif(p, '') as int), 0) > 255)) = 0))::bigint as n_ip,
  len(list_filter(card, lambda x: list_sum(list_transform(range(length(x)), lambda i: case when i % 2 = 0 then x[i + 1]::int when x[i + 1]::int > 4 then 2 * x[i + 1]::int - 9 else 2 * x[i + 1]::int end)) % 10 = 0))::bigint as n_card,
  len(list_filter(phone, lambda x: length(x) between 9 and 15))::bigint as n_phone
from sized
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": OP4_SQL, "op11_merkle": OP11_SQL, "op12_line_dedup": OP12_SQL, "whitening_deviations": DEVIATIONS_SQL, "rules_base_counts": RULES_SQL, "secrets_base_counts": SECRETS_SQL, "pii_base_counts": PII_SQL}
