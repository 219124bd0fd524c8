"""The registered queries of the operators, opN_<name>, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact_dedup, merkle, mixing, near_dedup, pieces, prefix_trie, quality, quality_rules, secrets, token_counts, toxicity
from .common import documents

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_N_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir), labels(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir), labels(spark, sf_dir))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP4_SQL = """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, role, text,
    CASE WHEN role IS NULL THEN 'null:' ELSE length(role) || ':' || role END
      || CASE WHEN text IS NULL THEN 'null:' ELSE length(text) || ':' || text END AS written,
    '<|im_start|>' || replace(replace(coalesce(role, 'unknown'), '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') || chr(10)
      || replace(replace(coalesce(text, ''), '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') || '<|im_end|>' || chr(10) AS block
  FROM conversations),
prefixes AS (
  SELECT conv_id, string_agg(written, '') OVER w AS prefix, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST ROWS UNBOUNDED PRECEDING)),
whole AS (SELECT min(conv_id) AS conv_id, any_value(n) AS n_turns, count(*) AS n_same, prefix FROM prefixes WHERE k = n GROUP BY prefix),
maximal AS (SELECT * FROM whole WHERE prefix NOT IN (SELECT prefix FROM prefixes WHERE k < n))
SELECT m.conv_id, n_turns, n_same, string_agg(block, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rendered
FROM maximal m JOIN turns t ON m.conv_id IS NOT DISTINCT FROM t.conv_id GROUP BY ALL
"""


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(documents(spark, sf_dir), width=2).drop("row")


OP5_SQL = rf"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT row, doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS grams FROM docs),
flat AS (SELECT row, len(grams) AS n, unnest(grams) AS gram FROM sets),
links AS (
  SELECT a.row AS x, b.row AS y FROM flat a JOIN flat b ON a.gram = b.gram AND a.row < b.row AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT row AS x, row AS y FROM sets UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x),
firsts AS (SELECT x AS row, min(doc_id) AS component_id FROM reach JOIN sets s ON s.row = y GROUP BY x)
SELECT doc_id, len(grams)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN firsts USING (row)
"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("row")


OP7_SQL = rf"""
WITH docs AS (
  SELECT doc_id, source, {_N_WORDS} AS size,
    1.0::DOUBLE / (1.0::DOUBLE + len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::DOUBLE / greatest({_N_WORDS}, 1)::DOUBLE) AS weight,
    (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w
  FROM docs GROUP BY source),
levels AS (
  SELECT *, 3.0::DOUBLE * source_size AS most,
    (sum(source_size) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER before, 0))
      / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM sources
  WINDOW before AS (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, least(most, w * min_by(level, most / w) FILTER (WHERE level * w <= most) OVER ()) AS target FROM levels),
runs AS (
  SELECT doc_id, size, source_size, target,
    CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY -ln(u) / weight, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (epochs * size + CASE WHEN 2.0 * (target - epochs * source_size - before) >= size THEN size ELSE 0 END)::BIGINT AS taken
FROM runs
"""


def op8_secret_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(documents(spark, sf_dir))


_ASSIGN = "(?:" + "|".join("".join(f"[{c.upper()}{c}]" for c in name) for name in ("password", "passwd", "secret", "token", "api_key", "apikey")).replace("[__]", "_") + r""")[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = {"assign": _ASSIGN, "access": "(AKIA[A-Z0-9]+)", "hex": "([0-9a-f]+)", "token": "([A-Za-z0-9+/_-]+)"}


def _places(kind: str) -> str:
    """(row, owner, repository, kind, rank, start, stop, value) of all matches: between them is what splitting leaves."""
    return f"""SELECT row, owner, repository, '{kind}' AS kind, {list(_KINDS).index(kind)} AS rank, value,
    sum(length(before) + length(whole)) OVER w - length(whole) AS start, sum(length(before) + length(whole)) OVER w AS stop
  FROM (SELECT row, owner, repository, unnest(regexp_extract_all(t, '{_KINDS[kind]}', 1)) AS value, unnest(regexp_extract_all(t, '{_KINDS[kind]}')) AS whole,
      unnest(string_split_regex(t, '{_KINDS[kind]}')) AS before, generate_subscripts(string_split_regex(t, '{_KINDS[kind]}'), 1) AS k FROM docs)
  WHERE whole IS NOT NULL WINDOW w AS (PARTITION BY row ORDER BY k)"""


def _written(condition: str) -> str:
    return f"coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (WHERE {condition}), '')"


OP8_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, source AS owner, doc_id AS repository, coalesce(text, '') AS t FROM documents),
matches AS ({" UNION ALL ".join(f"({_places(kind)})" for kind in _KINDS)}),
base AS (SELECT * FROM matches WHERE CASE kind WHEN 'assign' THEN length(value) >= 6 WHEN 'access' THEN length(value) >= 20 WHEN 'hex' THEN length(value) >= 24 ELSE false END),
tokens AS (
  SELECT * FROM matches m WHERE kind = 'token' AND length(value) >= 20 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
    AND NOT EXISTS (FROM base b WHERE b.row = m.row AND b.start < m.stop AND b.stop > m.start)),
found AS (SELECT * FROM base UNION ALL SELECT * FROM tokens),
spread AS (
  SELECT value, count(DISTINCT coalesce('o' || owner, 'n')) > {secrets.MOST_OWNERS} OR count(DISTINCT coalesce('r' || repository, 'n')) > {secrets.MOST_REPOSITORIES} AS example
  FROM found GROUP BY value),
judged AS (
  SELECT f.*, example, NOT example AND list_aggregate(string_split(value, ''), 'entropy') >= {secrets.LEAST_BITS} AS live FROM found f JOIN spread USING (value))
SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  sha256({_written("kind <> 'token'")}) AS base_sha256, {_written("kind <> 'token' OR live")} AS spans,
  coalesce(sum(live::BIGINT), 0)::BIGINT AS n_live, coalesce(sum(example::BIGINT), 0)::BIGINT AS n_example
FROM docs LEFT JOIN judged USING (row) GROUP BY row, doc_id
"""


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir)).drop("row")


OP10_SQL = f"""
WITH docs AS (SELECT doc_id, {_LOWER} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM docs WINDOW w AS (PARTITION BY t)
"""


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), prefix_trie.by_fives())


def _crc32(number: str) -> str:
    """Unsigned CRC-32 of a decimal number in SQL, bit by bit."""
    bits = "lambda x, i: xor(x >> 1, (x & 1) * 3988292384)"
    digits = f"list_transform(string_split({number}::VARCHAR, ''), lambda d: ascii(d)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {digits}), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), {bits})), 4294967295)"


OP11_SQL = f"""
WITH turns AS (
  SELECT conv_id, strlen(coalesce(text, '')) AS n_bytes, turn,
    sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn_sha
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, turn_sha, n_bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, turn_sha) - 1 AS place FROM turns),
sizes AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS base, {_crc32("conv_id")} % 9 AS head FROM own GROUP BY conv_id),
convs AS (SELECT s.*, least(s.head, coalesce(b.n, 0)) AS from_base, least(s.head, coalesce(b.n, 0)) + greatest(s.n - s.head, 0) AS length FROM sizes s LEFT JOIN sizes b ON b.conv_id = s.base),
rebuilt AS (
  SELECT c.conv_id, o.place, o.turn_sha, o.n_bytes FROM convs c JOIN own o ON o.conv_id = c.base WHERE o.place < c.head
  UNION ALL SELECT c.conv_id, o.place - c.head + c.from_base, o.turn_sha, o.n_bytes FROM convs c JOIN own o ON o.conv_id = c.conv_id WHERE o.place >= c.head),
paths AS (
  SELECT conv_id, place + 1 AS depth, string_agg(turn_sha, ',') OVER (PARTITION BY conv_id ORDER BY place) AS key, n_bytes FROM rebuilt
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
nodes AS (
  SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n_bytes) AS own_saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = length), '')) AS ends_sha256
  FROM paths JOIN convs USING (conv_id) GROUP BY depth, key),
parents AS (
  SELECT n.depth, n.conv_id, p.conv_id AS parent_conv_id FROM nodes n
  JOIN paths a ON a.conv_id = n.conv_id AND a.depth = n.depth - 1 JOIN nodes p ON p.depth = a.depth AND p.key = a.key),
counts AS (SELECT depth - 1 AS depth, parent_conv_id AS conv_id, count(*) AS n_children FROM parents GROUP BY ALL),
family AS (SELECT n.*, parent_conv_id, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN parents USING (depth, conv_id) LEFT JOIN counts USING (depth, conv_id)),
sums AS (
  SELECT a.depth, a.key, sum((n_children = 0)::BIGINT) AS n_leaves, sum(own_saved) AS saved_tokens
  FROM family f JOIN paths a ON a.conv_id = f.conv_id AND a.depth <= f.depth GROUP BY a.depth, a.key)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM family JOIN sums USING (depth, key)
"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.translate("text", merkle.UPPER, merkle.LOWER)
    return merkle.manifest(documents(spark, sf_dir), merkle.lower_third(F.col("doc_id")), lowered)


def _leaf(text: str) -> str:
    written = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    return f"sha256({' || '.join(map(written, ['doc_id', 'source', 'lang', 'n_chars', text]))})"


def _levels(name: str, leaves: str, group: str) -> str:
    """A recursive view of all levels of the trees over leaves: (group, level, place, digest, n), n nodes in the level."""
    return f"""{name} AS (
  SELECT {group}, 0 AS level, place, digest, n FROM {leaves}
  UNION ALL
  SELECT {group}, level + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place)), any_value((n + 7) // 8) FROM {name} WHERE n > 1 GROUP BY {group}, level, place // 8)"""


def _steps(name: str, leaves: str, levels: str, group: str, ident: str) -> str:
    """For each leaf and level the siblings before and after it."""
    own = "(l.place // (8 ** v.level)::BIGINT)"
    side = lambda sign: f"coalesce(string_agg(v.digest, '' ORDER BY v.place) FILTER (WHERE v.place {sign} {own}), '')"
    return f"""{name} AS (
  SELECT {ident}, v.level, {side("<")} AS b, {side(">")} AS a
  FROM {leaves} l JOIN {levels} v ON l.{group} IS NOT DISTINCT FROM v.{group} AND v.n > 1 AND v.place // 8 = {own} // 8
  GROUP BY {ident}, v.level)"""


OP12_SQL = f"""
WITH RECURSIVE hashed AS (
  SELECT row_number() OVER () AS row, doc_id, lang, {_leaf("text")} AS digest,
    CASE WHEN {_crc32("doc_id")} % 3 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf("text")} END AS forged
  FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, digest) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM hashed),
{_levels("lower_levels", "leaves", "lang")},
subroots AS (SELECT 0 AS top, lang, digest, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM lower_levels WHERE n = 1),
{_levels("upper_levels", "subroots", "top")},
{_steps("lower_steps", "leaves", "lower_levels", "lang", "l.row")},
{_steps("upper_steps", "subroots", "upper_levels", "top", "l.place")},
lower_paths AS (SELECT row, list({{'b': b, 'a': a}} ORDER BY level) AS steps FROM lower_steps GROUP BY row),
upper_paths AS (SELECT place, list({{'b': b, 'a': a}} ORDER BY level) AS steps FROM upper_steps GROUP BY place),
done AS (
  SELECT doc_id, l.digest AS leaf, forged, s.digest AS subroot, (SELECT digest FROM upper_levels WHERE n = 1) AS root,
    list_concat(coalesce(p.steps, []), coalesce(u.steps, [])) AS steps
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang LEFT JOIN lower_paths p USING (row) LEFT JOIN upper_paths u ON u.place = s.place),
folded AS (SELECT *, list_reduce(list_prepend({{'b': forged, 'a': ''}}, steps), lambda h, s: {{'b': sha256(s.b || h.b || s.a), 'a': ''}}).b AS folded_root FROM done)
SELECT doc_id, leaf, subroot, root, sha256(list_aggregate(list_prepend('', list_transform(steps, lambda s: s.b || s.a)), 'string_agg', '')) AS proof_sha256,
  folded_root, folded_root = root AS verified
FROM folded
"""


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_quality_rules": op2_quality_rules,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_chat_collapse": op4_chat_collapse,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_mix_sources": op7_mix_sources,
    "op8_secret_owners": op8_secret_owners,
    "op9_token_counts": op9_token_counts,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_sentencepiece": op13_sentencepiece,
}
SQL: dict[str, str] = {
    "op4_chat_collapse": OP4_SQL,
    "op5_minhash_near_dedup": OP5_SQL,
    "op7_mix_sources": OP7_SQL,
    "op8_secret_owners": OP8_SQL,
    "op10_exact_dedup": OP10_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_merkle_manifest": OP12_SQL,
}
