"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontam, language, line_dedup, merkle, mixing, pii, quality, secrets, sharding, simhash, suffix_dedup, warc
from .common import table

#: Target weights of the mixture: a quarter from the largest source, the rest in equal shares.
MIX = {"src0": 0.25}
MIX_DEFAULT = 0.75 / 19
#: Fetches until a page is asked for again, and time units of a bucket: revisits lie between the fetches
#: of other pages, and find their response in the same bucket or an earlier one.
DELAY, BUCKET = 40, 32


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=16)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), decontam.is_contaminated().alias("contaminated"),
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(quality.stored(table(spark, sf_dir, "documents"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed"
    )


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy decides, from op5's ledger."""
    return quality.ablation(quality.stored(table(spark, sf_dir, "documents")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.digest(suffix_dedup.cut_repeats(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") > 0).alias("has_repeats"), "spans")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.scan(table(spark, sf_dir, "documents")))


def op9_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve(warc.captures(table(spark, sf_dir, "pages"), DELAY), BUCKET)
    header = F.transform("headers", lambda h: F.concat(h["name"], F.lit("="), h["value"]))
    return found.select(
        F.col("record_id").alias("page_id"), "url", F.col("refers_to").alias("refers_to_page"), "verdict",
        F.array_join(header, ";").alias("headers"),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), MIX, MIX_DEFAULT, epochs=1.0)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.report(rows, conversations.damage(rows))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents")).drop("path")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith(("op", "quality_")) and callable(f)}


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0) x),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n) x),
hit AS (SELECT doc_id, i, dw.n AS n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) x GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""

LEDGER_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) > 5) x),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) y WHERE c > 1) z GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines,
             len(list_distinct(w)) AS vocabulary, len(list_filter(['the', 'be', 'to', 'of', 'and', 'that', 'have', 'with'], lambda x: list_contains(w, x))) AS stops,
             len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•‣●]'))) AS bullet,
             len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS ellipsis,
             len(list_filter(l, lambda x: regexp_matches(x, '[.!?"”][\x20\x09-\x0D]*$'))) AS ended,
             length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS digits, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS capitals,
             length(t) - length(regexp_replace(t, '[{}]', '', 'g')) AS braces, length(t) - length(replace(t, chr(65533), '')) AS broken,
             contains(lower(t), 'lorem ipsum') OR contains(lower(t), 'javascript') OR contains(lower(t), 'privacy policy') AS boilerplate
      FROM d LEFT JOIN r USING (doc_id)),
f AS (SELECT *, CAST(list_sum([CASE WHEN x THEN CAST(1 AS BIGINT) << (k - 1) ELSE 0 END FOR x, k IN [
        n_words < 10, 100 * n_repeat_words > 20 * n_words, 4 * n_symbols > n_words, n_dup_lines >= 5 AND 2 * n_dup_lines > n_lines,
        n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words), n_words > 100000, stops < 2, 10 * bullet > 9 * n_lines,
        10 * ellipsis > 3 * n_lines, 5 * digits > word_chars, 10 * capitals > 3 * word_chars, 20 * braces > n_words, boilerplate,
        10 * ended < n_lines, 10 * vocabulary < least(n_words, 1000), n_words < 2 * n_lines, 100 * broken > word_chars]]) AS INTEGER) AS failed FROM m)
"""

OP5_SQL = f"""{LEDGER_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, (failed & 31) = 0 AS kept, failed FROM f
"""

_RULES_SQL = ", ".join(f"('{p}', '{r}', {quality.mask(p)}, {1 << quality.RULES.index(r)})" for p, names in quality.POLICIES.items() for r in names)
ABLATION_SQL = f"""{LEDGER_SQL}
SELECT policy, rule, CAST(count(*) FILTER (failed & mask & bit <> 0) AS BIGINT) AS n_failed, CAST(count(*) FILTER (failed & mask = bit) AS BIGINT) AS n_only
FROM f, (VALUES {_RULES_SQL}) p(policy, rule, mask, bit) GROUP BY policy, rule
"""


OP9_SQL = rf"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, regexp_replace(regexp_replace(trim(coalesce(url, '')), '#.*$', ''), '^[hH][tT][tT][pP][sS]?://', '') AS u FROM pages),
q AS (SELECT page_id, html, regexp_replace(lower(regexp_extract(u, '^[^/?]*', 0)), '^www\.|:(80|443)$', '', 'g') AS host,
             regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
             list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]*|ref)='))) AS k FROM p),
c AS (SELECT page_id, host || path || CASE WHEN len(k) > 0 THEN '?' || array_to_string(k, '&') ELSE '' END AS url, CAST(strlen(html) AS VARCHAR) AS size,
             CASE WHEN page_id % 5 <> 0 THEN CASE WHEN page_id % 3 = 0 THEN 'W/' ELSE '' END || '"' || md5(html) || '"' END AS etag,
             CASE WHEN page_id % 2 = 0 THEN 'day ' || CAST(page_id // 100 AS VARCHAR) END AS lm FROM q),
j AS (SELECT v.page_id, v.url, v.etag, v.lm, r.page_id AS rid, r.etag AS retag, r.lm AS rlm, r.size,
             row_number() OVER (PARTITION BY v.page_id ORDER BY r.page_id DESC NULLS LAST) AS n
      FROM c v LEFT JOIN c r ON r.url = v.url AND v.url <> '' AND 2 * r.page_id < 2 * (v.page_id + {DELAY}) + 1),
a AS (SELECT *, coalesce(regexp_replace(etag, '^W/', '') = regexp_replace(retag, '^W/', ''), lm = rlm) AS agree FROM j WHERE n = 1)
SELECT page_id, url, rid AS refers_to_page,
       CASE WHEN rid IS NULL THEN 'no response' WHEN agree IS NULL THEN 'unchecked' WHEN agree THEN 'matched' ELSE 'mismatch' END AS verdict,
       CASE WHEN rid IS NOT NULL AND agree THEN concat_ws(';', 'content-length=' || size, 'content-type=text/html', 'date=' || CAST(2 * (page_id + {DELAY}) + 1 AS VARCHAR),
            'etag=' || coalesce(etag, retag), 'expires=' || CAST(page_id + {9 * DELAY} AS VARCHAR), 'last-modified=' || rlm) END AS headers
FROM a
"""


def mixing_sql(weights: dict[str, float], default: float, seed: int = 17, docs: str = "documents") -> str:
    cases = "".join(f" WHEN '{k}' THEN CAST({v!r} AS DOUBLE)" for k, v in weights.items())
    unit = "CAST(('0x' || substr(md5('{0}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || {1}), 1, 13))::BIGINT AS DOUBLE) / 4503599627370496.0"
    return f"""
WITH RECURSIVE s AS (SELECT coalesce(source, '') AS src, count(*) AS n, CASE coalesce(source, ''){cases} ELSE CAST({default!r} AS DOUBLE) END AS w FROM {docs} GROUP BY 1),
r AS (SELECT src, w / (SELECT sum(w) FROM s) * 1.0 * (SELECT sum(n) FROM s) / n AS rate FROM s),
q AS (SELECT src, greatest(1, CAST(ceil(rate / 8.0) AS INTEGER)) AS parts, rate / greatest(1, CAST(ceil(rate / 8.0) AS INTEGER)) AS one FROM r),
c AS (SELECT src, parts, one, 0 AS k, exp(-one) AS p, exp(-one) AS cum FROM q
      UNION ALL SELECT src, parts, one, k + 1, p * one / (k + 1), cum + p * one / (k + 1) FROM c WHERE k < 64),
t AS (SELECT src, any_value(parts) AS parts, list(cum ORDER BY k) AS cdf FROM c GROUP BY src),
rows_ AS MATERIALIZED (SELECT *, row_number() OVER () AS rn FROM {docs}),
u AS (SELECT rn, doc_id, cdf, unnest(range(0, parts)) AS part FROM rows_ d JOIN t ON t.src = coalesce(source, '')),
n AS (SELECT rn, sum(len(list_filter(cdf, lambda x: x <= {unit.format(seed, "part")}))) AS copies FROM u GROUP BY rn)
SELECT doc_id, text, lang, source, n_chars, CAST(copies AS INTEGER) AS copies, CAST(replica AS INTEGER) AS replica,
       md5('order:{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || replica) AS shuffle_key
FROM (SELECT r.*, copies, unnest(range(0, CAST(copies AS BIGINT))) AS replica FROM n JOIN rows_ r ON r.rn = n.rn WHERE copies > 0) x
"""


#: CRC-32 of the ASCII text {0}, by a table of 256 entries in `crc(t)`.
_CRC = "xor(list_reduce([CAST(4294967295 AS UBIGINT)] || list_transform(string_split({0}, ''), lambda x: CAST(ord(x) AS UBIGINT)), lambda c, b: xor(t[CAST((xor(c, b) & 255) + 1 AS BIGINT)], c >> 8)), CAST(4294967295 AS UBIGINT))"
_CRC_TABLE = "crc AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce([b] || list_transform(range(8), lambda k: CAST(k AS UBIGINT)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END) AS c FROM (SELECT CAST(range AS UBIGINT) AS b FROM range(256)) q) q)"


def _repair_sql() -> str:
    """Backwards from a conversation's last row: for each state (0, s, u, a) the cheapest rest, as a string of cost and letters."""

    def best(*ways: str) -> str:
        return f"least({', '.join(ways)})"

    def add(cost: int | str, letter: str, rest: str) -> str:
        return f"lpad(CAST(CAST(left({rest}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || '{letter}' || substr({rest}, 10)"

    wanted, none = {"o": "u", "s": "u", "u": "a", "a": "u"}, "'999999999'"
    follows = {"o": "su", "s": "u", "u": "a", "a": "u"}
    row = {}
    for state in "osua":
        kept = " ".join(f"WHEN initial = '{i}' AND NOT gone THEN {add('IF(cut, 5, 0)', 'K', 'b.' + i)}" for i in follows[state])
        row[state] = best(add(2, "D", "b." + state), f"IF(gone, {none}, {add('1 + IF(cut, 5, 0)', 'R', 'b.' + wanted[state])})", f"CASE {kept} ELSE {none} END")

    def closed(names: dict[str, str]) -> str:
        ways = {}
        for state in "osua":
            first = add(5, "I", names[wanted[state]])
            ways[state] = best(names[state], first, add(5, "I", f"({add(5, 'I', names[wanted[wanted[state]]])})"))
        return ", ".join(f"{v} AS {k}" for k, v in ways.items())

    raw = ", ".join(f"{v} AS x{k}" for k, v in row.items())
    return rf"""
WITH RECURSIVE {_CRC_TABLE},
k AS MATERIALIZED (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS d FROM conversations, crc),
r AS MATERIALIZED (SELECT conv_id, turn, IF(d = 4, 'user', role) AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
      unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM r),
f AS MATERIALIZED (SELECT *, left(role, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'b' WHEN seen > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 't' ELSE '' END AS fault,
      lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM n),
c AS MATERIALIZED (SELECT conv_id, count(*) AS rows_, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
      count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
e AS (SELECT xo AS o, xs AS s, xu AS u, xa AS a FROM (SELECT '000000000' AS xo, {none} AS xs, {none} AS xu, '000000000' AS xa) q),
w AS (SELECT c.conv_id, rows_ AS left_, {closed({k: "e." + k for k in "osua"})} FROM c, e
      UNION ALL SELECT conv_id, left_, {closed({k: "x" + k for k in "osua"})} FROM (SELECT b.conv_id, left_ - 1 AS left_, {raw} FROM w b JOIN (SELECT *, fault IN ('b', 'd') AS gone, fault = 't' AS cut FROM f) f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.left_ WHERE left_ > 0) q),
p AS MATERIALIZED (SELECT conv_id, CAST(left(o, 9) AS BIGINT) AS cost, substr(o, 10) AS audit FROM w WHERE left_ = 0),
l AS (SELECT p.conv_id, g, substr(audit, g, 1) AS letter, length(translate(left(audit, g), 'I', '')) AS i, audit FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS g FROM p) p),
z AS (SELECT l.conv_id, g, letter, role, text, left(f.role, 1) = 's' AND letter = 'K' AS lead FROM l LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i WHERE letter <> 'D'),
y AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY g) + CAST(bool_or(lead) OVER (PARTITION BY conv_id) AS INT) AS place FROM z),
h AS (SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || IF(letter = 'I', '', text), chr(10) ORDER BY g)) AS sha FROM y GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
       coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN p ON p.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def _merkle_sql(levels: int = 7, fan: int = 8) -> str:
    """The tree level by level: runs of up to 8**levels leaves a language, and as many languages."""

    def enc(value: str) -> str:
        return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    head = " || ".join(enc(c) for c in ("doc_id", "source", "lang", "n_chars"))
    parts = [rf"""{_CRC_TABLE},
d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, coalesce('=' || lang, '') AS tree, sha256({head} || {enc("text")}) AS leaf,
      IF({_CRC.format("CAST(doc_id AS VARCHAR)")} % 3 = 0, sha256({head} || {enc(lower)}), NULL) AS fake FROM documents, crc),
a0 AS MATERIALIZED (SELECT id, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, leaf AS node FROM d)"""]
    for letter, key in (("a", "tree"), ("b", "1")):
        if letter == "b":
            parts.append(f"b0 AS MATERIALIZED (SELECT tree AS id, 1 AS tree, row_number() OVER (ORDER BY tree) - 1 AS rank, node FROM a{levels})")
        for k in range(levels):
            # a tree with one node left passes it on
            parts.append(f"""{letter}{k + 1} AS MATERIALIZED (SELECT tree, rank // {fan} AS rank, IF(max(alone), any_value(node), sha256(string_agg(node, '' ORDER BY rank))) AS node
      FROM (SELECT *, max(rank) OVER (PARTITION BY tree) = 0 AS alone FROM {letter}{k}) q GROUP BY tree, rank // {fan})""")
    steps = []
    for letter, base, tree, rank in (("a", 0, "a0.tree", "a0.rank"), ("b", levels, "1", "b0.rank")):
        for k in range(levels):
            steps.append(f"SELECT a0.id, {base + k} AS level, x.rank < {rank} // {fan**k} AS before, x.rank AS place, x.node FROM a0 JOIN b0 ON b0.id = a0.tree JOIN {letter}{k} x ON x.tree = {tree} AND x.rank // {fan} = {rank} // {fan ** (k + 1)} AND x.rank <> {rank} // {fan**k}")
    parts.append("s AS MATERIALIZED (" + " UNION ALL ".join(steps) + ")")
    # a run of one has no siblings but is hashed where its tree has more nodes
    parts.append("proof AS (SELECT id, sha256(string_agg(node, '' ORDER BY level, place)) AS proof FROM s GROUP BY id)")
    parts.append("g AS MATERIALIZED (SELECT id, level, string_agg(node, '' ORDER BY place) FILTER (before) AS l, string_agg(node, '' ORDER BY place) FILTER (NOT before) AS r FROM s GROUP BY id, level)")
    parts.append("h AS (" + " UNION ALL ".join(f"SELECT tree AS t, {k} AS level FROM a{k} GROUP BY tree HAVING max(rank) > 0" for k in range(levels)) + ")")
    parts.append("top AS (" + " UNION ALL ".join(f"SELECT {levels + k} AS level FROM b{k} HAVING max(rank) > 0" for k in range(levels)) + ")")
    parts.append(f"""u AS (SELECT id, a0.tree AS t, -1 AS level, coalesce(fake, leaf) AS node FROM d JOIN a0 USING (id)
      UNION ALL SELECT u.id, u.t, u.level + 1, IF(EXISTS (SELECT 1 FROM h WHERE h.t = u.t AND h.level = u.level + 1) OR EXISTS (SELECT 1 FROM top WHERE top.level = u.level + 1), sha256(coalesce(l, '') || u.node || coalesce(r, '')), u.node)
      FROM u LEFT JOIN g ON g.id = u.id AND g.level = u.level + 1 WHERE u.level < {2 * levels - 1})""")
    return "WITH RECURSIVE " + ",\n".join(parts) + f"""
SELECT d.doc_id, d.leaf, a{levels}.node AS subroot, b{levels}.node AS root, coalesce(proof, sha256('')) AS proof_sha256, u.node AS folded_root, u.node = b{levels}.node AS verified
FROM d JOIN a0 USING (id) JOIN a{levels} ON a{levels}.tree = a0.tree JOIN b{levels} ON true LEFT JOIN proof ON proof.id = d.id JOIN u ON u.id = d.id AND u.level = {2 * levels - 1}
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": OP3_SQL, "op5_quality_rules": OP5_SQL, "quality_ablation": ABLATION_SQL, "op9_revisits": OP9_SQL, "op10_mixing": mixing_sql(MIX, MIX_DEFAULT),
            "op11_conversation_repair": _repair_sql(), "op12_merkle_manifest": _merkle_sql()}
