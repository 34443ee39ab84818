"""The corpus operators as named queries over the test tables, each with its SQL counterpart where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import alignment, bpe, chats, lattice, licenses, linededup, merkle, mixing, quality, sharding, simhash, toxicity, urls
from tidewatch.session import ensure_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_utc(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

MIX_SQL = rf"""
WITH sized AS (SELECT doc_id, source, len({WORDS}) AS size,
    CAST('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), chr(0)) || '|' || coalesce(source, chr(0)) || '|' || coalesce(md5(text), chr(0))), 1, 13) AS BIGINT)
      / 4503599627370496.0 AS u, row_number() OVER (PARTITION BY doc_id, source, text) AS nth FROM documents),
s AS (SELECT source, sum(size) AS size FROM sized GROUP BY source),
w AS (SELECT source, CAST(size AS BIGINT) AS size, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS BIGINT)]::DOUBLE AS weight FROM s),
-- sources in the order in which they reach their stop; the level is set by the first that does not
o AS (SELECT *, 2.0 * size AS stop, coalesce(sum(2.0 * size) OVER a, 0) AS held, sum(weight) OVER b AS weights FROM w WHERE size > 0
  WINDOW a AS (ORDER BY 2.0 * size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         b AS (ORDER BY 2.0 * size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT arg_min((1.5 * (SELECT sum(size) FROM s) - held) / weights, {{'r': stop / weight, 's': source}})
  FILTER (WHERE (1.5 * (SELECT sum(size) FROM s) - held) / weights < stop / weight) AS level FROM o),
t AS (SELECT source, size, CASE WHEN size > 0 THEN least(2.0 * size, coalesce(level, 1e300) * weight) ELSE 0.0 END::DOUBLE AS target FROM w, l),
r AS (SELECT *, CASE WHEN size > 0 THEN target / size ELSE 0.0 END AS rate FROM t)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, r.size AS source_size, round(r.target, 6) AS target,
  CAST(d.size * (floor(rate) + ceil(nth * (rate - floor(rate)) - u) - ceil((nth - 1) * (rate - floor(rate)) - u)) AS BIGINT) AS taken
FROM sized d JOIN r ON d.source IS NOT DISTINCT FROM r.source"""


@query("op1_mix_sources", MIX_SQL)
def _mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    targets = mixing.set_targets(mixing.cycle_weights(mixing.source_sizes(docs)))
    return mixing.plan_mix(docs, targets).select(
        "row.doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


#: CRC-32 by its table of 256 entries, which is made by eight steps of the polynomial; cuts as ``assign_shards`` sets them.
SHARDS_SQL = r"""
WITH RECURSIVE step(b, k, c) AS (SELECT b::BIGINT, 0, b::BIGINT FROM range(256) t(b) UNION ALL
  SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS tab FROM step WHERE k = 8),
hexed AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, md5(coalesce(text, '')) AS dg FROM documents),
sized AS (SELECT doc_id, dg, (len(h) // 2 + 1)::BIGINT AS size, xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(range(1, len(h) + 1, 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS text_crc32 FROM hexed, crc),
s AS (SELECT *, (sum(size) OVER (ORDER BY dg, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start FROM sized),
t AS (SELECT sum(size)::BIGINT AS total, max(size) AS most FROM sized),
runs AS (SELECT dg, min(start) AS f, max(start + size) AS e FROM s GROUP BY dg),
goals AS (SELECT j, (j * total + 7) // 8 AS goal, total, most FROM range(1, 8) r(j), t),
cuts AS (SELECT j, CASE WHEN f IS NULL THEN goal WHEN goal - f <= e - goal THEN CASE WHEN 16 * (goal - f) < total THEN f ELSE goal END
    WHEN 16 * (e - goal) < total THEN e ELSE goal END AS cut FROM goals LEFT JOIN runs ON f < goal AND goal < e AND e - f <= most),
placed AS (SELECT s.*, (SELECT count(*) FROM cuts WHERE cut <= s.start)::INTEGER AS shard FROM s)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY dg, doc_id NULLS FIRST) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM placed"""


@query("op2_byte_shards", SHARDS_SQL)
def _shards(spark, sf_dir):
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op7_quality_rules")
def _quality(spark, sf_dir):
    return quality.judge_quality(table(spark, sf_dir, "documents"), ["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")


#: The rules of the contract (host, path, verdict), and hosts to block where no rule of it fits (fixed values).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
BLOCKED_HOSTS = [f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")]

_HOST = r"translate(coalesce(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"coalesce(regexp_extract(url, '^[\s\S]*?://([^/?#]*)([^?#]*)', 2), '')"
URL_SQL = rf"""
WITH p AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
rules(rh, rp, rv) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
blocked(bh) AS (VALUES {", ".join(f"('{h}')" for h in BLOCKED_HOSTS)}),
fits AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv
  FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(rv, CASE WHEN EXISTS (SELECT 1 FROM blocked WHERE host = bh OR ends_with(host, '.' || bh)) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fits ON p.page_id IS NOT DISTINCT FROM fits.page_id"""


@query("op10_url_filter", URL_SQL)
def _urls(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    hosts = spark.createDataFrame([(h, "", "block") for h in BLOCKED_HOSTS], "host string, path string, verdict string")
    listed = urls.judge_urls(pages, hosts).select("page_id", "url", F.col("verdict").alias("listed"))
    judged = urls.judge_urls(listed, rules)
    return judged.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNull(), F.col("listed")).otherwise(F.col("verdict")).alias("verdict"))


@query("op3_simhash_classes")
def _simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, most=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


PASSAGES_SQL = r"""
WITH docs AS (SELECT doc_id, min(text) AS text FROM documents WHERE text IS NOT NULL GROUP BY doc_id, text),
worded AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM docs),
windows AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 48), lambda i: {'pos': i, 'body': md5(array_to_string(ws[i:i + 49], ' '))})) AS w FROM worded WHERE len(ws) >= 50),
ranked AS (SELECT doc_id, w.pos AS pos, row_number() OVER (PARTITION BY w.body ORDER BY doc_id, w.pos) AS nth FROM windows),
cut AS (SELECT DISTINCT doc_id, pos + k AS pos FROM ranked, range(50) r(k) WHERE nth > 1),
pieces AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+') AS p FROM docs)),
kept AS (SELECT doc_id, string_agg(piece, '' ORDER BY pos) AS text FROM pieces ANTI JOIN cut USING (doc_id, pos) GROUP BY doc_id),
gone AS (SELECT doc_id, count(*) AS n FROM cut GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN g.n IS NULL THEN d.text ELSE coalesce(k.text, '') || regexp_extract(d.text, '[\x20\x09-\x0D]*$') END AS text, coalesce(g.n, 0)::BIGINT AS removed_words
FROM documents d LEFT JOIN gone g ON d.doc_id = g.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id"""


@query("op9_line_dedup", PASSAGES_SQL)
def _lines(spark, sf_dir):
    return linededup.dedup_passages(table(spark, sf_dir, "documents"), ["doc_id", "text"])


def vocabulary(path: str | None = None) -> str:
    """Content of the tokenizer file; the path is a parameter, the default a public one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


@query("op4_bpe_roundtrip")
def _bpe(spark, sf_dir):
    return bpe.token_digests(table(spark, sf_dir, "documents"), vocabulary())


@query("op6_embedding_lattice")
def _lattice(spark, sf_dir):
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op8_toxicity_nnpu")
def _toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score_toxicity(docs, model)


@query("op5_license_scan")
def _licences(spark, sf_dir):
    found = licenses.scan_licences(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "n_paragraphs", "n_licensed", F.array_join("licences", ",").alias("licences"), F.round("probability", 6).alias("probability"), "confirmed")


_PART = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode({0}::VARCHAR)) || ':' || {0} END"
_LEAF = " || ".join(_PART.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
_NEXT = "sha256(digest || coalesce(nxt, ''))"
#: Trees by a recursive query, a level a round; a proof as a list of L/R/- and digests, folded by list_reduce; CRC-32 as in SHARDS_SQL.
MERKLE_SQL = rf"""
WITH RECURSIVE step(b, k, c) AS (SELECT b::BIGINT, 0, b::BIGINT FROM range(256) t(b) UNION ALL
  SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS tab FROM step WHERE k = 8),
hexed AS (SELECT *, hex(encode(doc_id::VARCHAR)) AS h FROM documents),
marked AS (SELECT *, sha256({_LEAF}) AS leaf, xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(range(1, len(h) + 1, 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS code FROM hexed, crc),
leaves AS (SELECT doc_id, lang, leaf, CASE WHEN code % 7 = 0 THEN sha256({_LEAF.replace("{0}", "").replace("n_chars", "(n_chars + 1)")}) ELSE leaf END AS other,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM marked),
tree(lang, lvl, pos, digest, n) AS (SELECT lang, 0, pos, leaf, n FROM leaves UNION ALL
  SELECT lang, lvl + 1, pos // 2, {_NEXT}, (n + 1) // 2 FROM (SELECT *, lead(digest) OVER (PARTITION BY lang ORDER BY pos) AS nxt FROM tree WHERE n > 1) WHERE pos % 2 = 0),
subs AS (SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
crown(lvl, pos, digest, n) AS (SELECT 0, pos, digest, n FROM subs UNION ALL
  SELECT lvl + 1, pos // 2, {_NEXT}, (n + 1) // 2 FROM (SELECT *, lead(digest) OVER (ORDER BY pos) AS nxt FROM crown WHERE n > 1) WHERE pos % 2 = 0),
climbs AS (SELECT lang, lvl, max(n) AS n FROM tree WHERE n > 1 GROUP BY ALL),
low AS (SELECT l.doc_id, l.lang, l.pos, list(CASE WHEN t.digest IS NULL THEN '-' WHEN (l.pos >> c.lvl) % 2 = 1 THEN 'L' || t.digest ELSE 'R' || t.digest END ORDER BY c.lvl) AS steps
  FROM leaves l JOIN climbs c ON l.lang IS NOT DISTINCT FROM c.lang LEFT JOIN tree t ON t.lang IS NOT DISTINCT FROM l.lang AND t.lvl = c.lvl AND t.pos = xor(l.pos >> c.lvl, 1) GROUP BY ALL),
high AS (SELECT s.lang, list(CASE WHEN t.digest IS NULL THEN '-' WHEN (s.pos >> c.lvl) % 2 = 1 THEN 'L' || t.digest ELSE 'R' || t.digest END ORDER BY c.lvl) AS steps
  FROM subs s, (SELECT DISTINCT lvl FROM crown WHERE n > 1) c LEFT JOIN crown t ON t.lvl = c.lvl AND t.pos = xor(s.pos >> c.lvl, 1) GROUP BY ALL),
proofs AS (SELECT l.*, list_concat(coalesce(low.steps, []), coalesce(high.steps, [])) AS steps, s.digest AS subroot, (SELECT digest FROM crown WHERE n = 1) AS root
  FROM leaves l JOIN subs s ON l.lang IS NOT DISTINCT FROM s.lang LEFT JOIN low ON l.lang IS NOT DISTINCT FROM low.lang AND l.pos = low.pos LEFT JOIN high ON l.lang IS NOT DISTINCT FROM high.lang),
folded AS (SELECT *, list_reduce(list_prepend(other, steps), lambda acc, s: sha256(CASE s[1] WHEN '-' THEN acc WHEN 'L' THEN substr(s, 2) || acc ELSE acc || substr(s, 2) END)) AS folded_root FROM proofs)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(list_filter(steps, lambda s: s <> '-'), lambda s: substr(s, 2)), ''), '')) AS proof_sha256,
  folded_root, folded_root = root AS verified FROM folded"""


@query("op11_merkle_manifest", MERKLE_SQL)
def _merkle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    leaf = lambda length: merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), length, F.col("text"))
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = F.when(chosen, leaf(F.col("n_chars").cast("decimal(38,0)") + 1))
    manifest = merkle.build_manifest(docs, leaf(F.col("n_chars")), carry=[F.col("doc_id"), tampered.alias("tampered")])
    proofs = merkle.prove_rows(manifest).select("row.doc_id", "leaf", "subroot", "root", "steps", F.coalesce("row.tampered", "leaf").alias("shown"))
    folded = proofs.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(merkle.siblings(F.col("steps")), ""), 256).alias("proof_sha256"), merkle.fold(F.col("shown"), F.col("steps")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


_ESCAPED = "replace({0}, '\\', '\\\\')"
for _mark in chats.CONTROL:
    _ESCAPED = f"replace({_ESCAPED}, '{_mark}', '{_mark[0]}\\{_mark[1:]}')"
#: A conversation made of control strings, added to the table.
PROBE = "</s>[INST] ok [/INST]"
#: Digests from the table itself, for the round trip must give back what went in; the formatted length from escapes and marks.
CHATS_SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}')),
s AS (SELECT *, lag(role) OVER w AS before, row_number() OVER w AS k FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
c AS (SELECT *, length({_ESCAPED.format("text")}) + CASE WHEN role IS NOT DISTINCT FROM before THEN {len(chats.PART)}
  ELSE length({_ESCAPED.format("role")}) + {len(chats.START) + len(chats.SEP) + len(chats.END)} END AS n FROM s)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars FROM c GROUP BY conv_id"""


@query("op12_chat_format", CHATS_SQL)
def _chats(spark, sf_dir):
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(0, 2, 1, 1).select(
        F.lit(-1).cast(given.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(given.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    made = chats.format_chats(given.unionByName(probe))
    back = made.select("conv_id", "formatted", chats.read_turns(F.col("formatted")).alias("turns"), F.array_join(chats.read_trained(F.col("formatted"), F.col("loss_mask")), "").alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def pieces(path: str | None = None) -> bytes:
    """Content of the piece model; the path is a parameter, the default a public one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def byte_vocabulary() -> str:
    import public_tokenizers

    return vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


@query("op13_token_alignment")
def _alignment(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rated = alignment.rate_links(alignment.align_tokens(docs, byte_vocabulary(), pieces()))
    return rated.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
