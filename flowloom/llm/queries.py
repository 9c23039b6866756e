"""The queries of this subpackage: one per operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import alignment, bpe_trie, corpus, exact_dedup, hnsw, minhash, mixing, phrases, pii, quality, range_coder, scratch, shards, token_counts, url_filter

END_ID = 2
#: action, host, path.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return mixing.mix(docs, corpus.LEVELS, corpus.WEIGHTS, fraction=0.6, max_epochs=2, seed=17)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path(corpus.VOCABULARY), limit=1024)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), corpus.HOST, corpus.PATH)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), threshold=0.8)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.place(spark, "token-files")
    range_coder.write(_read(spark, sf_dir, "documents"), public_tokenizers.path(corpus.VOCABULARY), path, END_ID)
    return range_coder.read(spark, path)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path(corpus.VOCABULARY)
    return bpe_trie.digests(bpe_trie.round_trip(_read(spark, sf_dir, "documents"), vocabulary))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(_read(spark, sf_dir, "documents"), n_shards=40)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(_read(spark, sf_dir, "documents"), keep="largest")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_read(spark, sf_dir, "documents"))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, URL_RULES))} AS rules(action, host, path)")
    return url_filter.judge(_read(spark, sf_dir, "pages"), rules)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(_read(spark, sf_dir, "documents"), least=30, top=2000)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_texts(_read(spark, sf_dir, "documents"), public_tokenizers.path(corpus.VOCABULARY), public_tokenizers.path(corpus.PIECES))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_token_counts, op3_quality, op4_near_duplicates, op5_token_files, op6_bpe, op7_neighbours, op8_shards, op9_exact_dedup, op10_pii, op11_url_filters, op12_phrases, op13_alignment)}


def _case(column: str, weights: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END" if weights else "1"


def _deal_sql(depth: int, levels: list[str], weights: dict[str, dict[str, int]]) -> str:
    """One level of water-filling: table given{depth} from given{depth - 1}."""
    up, own, name = levels[: depth - 1], levels[:depth], levels[depth - 1]
    parent = f"PARTITION BY {', '.join(up)}" if up else ""
    join = " AND ".join(f"n.{c} IS NOT DISTINCT FROM g.{c}" for c in up) or "TRUE"
    return f"""
    node{depth} AS (SELECT {", ".join(own)}, sum(most)::HUGEINT AS most, {_case(name, weights.get(name, {}))} AS weight FROM leaves GROUP BY {", ".join(own)}),
    dealt{depth} AS (SELECT n.*, g.given - coalesce(sum(n.most) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
        sum(n.weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
        FROM node{depth} n JOIN given{depth - 1} g ON {join} WHERE n.weight > 0
        WINDOW w AS ({parent.replace("BY ", "BY n.").replace(", ", ", n.")} ORDER BY n.most::DOUBLE / n.weight, n.{name})),
    full{depth} AS (SELECT *, most * share <= left_over * weight AS is_full FROM dealt{depth}),
    floor{depth} AS (SELECT *, max(CASE WHEN NOT is_full THEN left_over END) OVER ({parent}) AS open_left, max(CASE WHEN NOT is_full THEN share END) OVER ({parent}) AS open_share,
        CASE WHEN is_full THEN most ELSE (open_left * weight) // open_share END::HUGEINT AS down, CASE WHEN is_full THEN -1 ELSE (open_left * weight) % open_share END AS part FROM full{depth}),
    given{depth} AS (SELECT {", ".join(own)}, (down + CASE WHEN NOT is_full AND row_number() OVER ({parent} ORDER BY part DESC, {name} NULLS FIRST)
        <= open_left - sum(CASE WHEN NOT is_full THEN down ELSE 0 END) OVER ({parent}) THEN 1 ELSE 0 END)::HUGEINT AS given FROM floor{depth})"""


def mixing_sql(weights: dict[str, dict[str, int]] = corpus.WEIGHTS, fraction: float = 0.6, epochs: int = 2) -> str:
    levels = ["domain", "lang", "source"]
    lives = " AND ".join(f"{_case(c, weights.get(c, {}))} > 0" for c in levels)
    same = lambda a, b: " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in levels)
    return f"""
    WITH docs AS (SELECT doc_id, {corpus.DOMAIN} AS domain, lang, source, coalesce(len(regexp_extract_all(text, '[^ \\t\\r\\n]+')), 0)::BIGINT AS n_tokens FROM documents),
    leaves AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens, CASE WHEN {lives} THEN sum(n_tokens)::HUGEINT * {epochs} ELSE 0 END AS most FROM docs GROUP BY domain, lang, source),
    given0 AS (SELECT least(CAST(trunc(CAST(sum(tokens) AS DOUBLE) * {fraction}) AS HUGEINT), sum(most)::HUGEINT) AS given FROM leaves),
    {", ".join(_deal_sql(d, levels, weights) for d in (1, 2, 3))},
    plan AS (SELECT l.*, CASE WHEN l.tokens > 0 THEN g.given // l.tokens ELSE 0 END AS whole, CASE WHEN l.tokens > 0 THEN g.given % l.tokens ELSE 0 END AS rest
        FROM leaves l JOIN given3 g ON {same("l", "g")}),
    rows_ AS (SELECT d.*, p.whole, p.rest, md5('17-' || p.whole::VARCHAR || '-' || d.doc_id::VARCHAR) AS h FROM docs d JOIN plan p ON {same("d", "p")}),
    placed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id) - n_tokens AS ahead FROM rows_),
    epochs AS (SELECT *, unnest(range(whole::BIGINT + 1)) AS e FROM placed)
    SELECT doc_id, domain, lang, source, e::INT AS epoch, n_tokens, CASE WHEN e < whole THEN n_tokens ELSE least(n_tokens, rest - ahead)::BIGINT END AS take_tokens
    FROM epochs WHERE e < whole OR ahead < rest"""


EXACT_SQL = """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""


def _address_sql(url: str) -> str:
    """host, path and query of the column url, which has a ://."""
    after = f"substr({url}, instr({url}, '://') + 3)"
    host = f"regexp_extract({after}, '^[^/?#]*')"
    rest = f"substr({after}, length({host}) + 1)"
    kept = f"array_to_string(list_filter(string_split(regexp_extract({rest}, '^[^?#]*[?]([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{url_filter.TRACKING}')), '&')"
    return f"""translate({host}, '{url_filter.UPPER}', '{url_filter.LOWER}') AS host, regexp_extract({rest}, '^[^?#]*') AS path, CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END AS query"""


def _link_sql(tag: str, link: str) -> str:
    quoted = [x.replace("'", "''") for x in (tag, link)]
    return f"replace(regexp_extract(regexp_extract(html, '{quoted[0]}'), '{quoted[1]}', 1), '&amp;', '&')"


def _url_sql() -> str:
    rules = ", ".join(map(str, URL_RULES))
    links = [_link_sql(url_filter.CANONICAL_TAG, url_filter.HREF), _link_sql(url_filter.REFRESH_TAG, url_filter.REFRESH_URL)]
    plain_host, plain_path = r"regexp_replace(host, '^(www|m)\.', '')", r"regexp_replace(path, '(/index\.html?|\.html?|/)\z', '')"
    return f"""
    WITH RECURSIVE rules(action, rule_host, rule_path) AS (VALUES {rules}),
    own AS (SELECT page_id, html, url, {_address_sql("url")} FROM pages WHERE contains(url, '://')),
    links AS (SELECT DISTINCT host, path, query, url, unnest([{", ".join(links)}]) AS link FROM own),
    full_links AS (SELECT *, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link WHEN link LIKE '//%' THEN split_part(url, '://', 1) || ':' || link
        WHEN link LIKE '/%' THEN split_part(url, '://', 1) || '://' || host || link END AS target FROM links),
    ends AS (SELECT host || path || query AS a, target FROM full_links WHERE target IS NOT NULL),
    targets AS (SELECT a, {_address_sql("target")} FROM ends),
    known AS (SELECT DISTINCT host, path, query FROM (SELECT host, path, query FROM own UNION ALL SELECT host, path, query FROM targets) WHERE host <> ''),
    nodes AS (SELECT host, path, query, host || path || query AS name FROM (SELECT * FROM known UNION SELECT {plain_host}, {plain_path}, query FROM known) WHERE host <> ''),
    edges AS (SELECT name AS a, {plain_host} || {plain_path} || query AS b FROM nodes UNION SELECT a, host || path || query FROM targets WHERE host <> ''),
    both_ways AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
    reach AS (SELECT name AS a, name AS b FROM nodes UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
    fits AS (SELECT name, arg_min(struct_pack(action := action, rule := rule_host || rule_path), struct_pack(s := -length(rule_host || rule_path), r := rule_host || rule_path)) AS best
        FROM nodes JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY name),
    verdicts AS (SELECT r.a, max(f.best.action) AS most, min(f.best.action) AS least, count(*) AS size, list(n.name ORDER BY n.host, n.path, n.query)[1] AS via
        FROM reach r JOIN nodes n ON n.name = r.b LEFT JOIN fits f ON f.name = r.b GROUP BY r.a)
    SELECT p.page_id, coalesce(o.host, '') AS host, coalesce(o.path, '') AS path, f.best.rule AS rule,
        coalesce(f.best.action, CASE WHEN v.least = 'block' THEN 'block' ELSE 'allow' END) AS verdict, CASE WHEN v.size > 1 THEN v.via END AS via
    FROM pages p LEFT JOIN own o ON o.page_id = p.page_id AND o.url = p.url LEFT JOIN fits f ON f.name = o.host || o.path || o.query LEFT JOIN verdicts v ON v.a = o.host || o.path || o.query"""


def _phrases_sql() -> str:
    parts = "UNION ALL ".join(f"SELECT p.lang, p.phrase, p.a, {k} AS cut, array_to_string(string_split(p.phrase, ' ')[:{k}], ' ') AS head, array_to_string(string_split(p.phrase, ' ')[{k + 1}:], ' ') AS tail FROM often p WHERE p.k > {k} " for k in (1, 2, 3))
    inner = "UNION ALL ".join(f"SELECT lang, a, array_to_string(string_split(phrase, ' ')[{i}:{i + n - 1}], ' ') AS phrase FROM often WHERE k > {n} AND k >= {i + n - 1} " for n in (2, 3) for i in range(1, 5 - n + 1))
    return rf"""
    WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'), '[.,;:!?
-
]')) AS piece FROM documents),
    lists AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM pieces),
    spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
    counted AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM spots, range(1, 5) t(k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
    totals AS (SELECT lang, sum(a)::BIGINT AS n FROM counted WHERE k = 1 GROUP BY lang),
    often AS (SELECT * FROM counted WHERE a >= 30),
    cuts AS ({parts}),
    scored AS (SELECT c.lang, c.phrase, c.a, c.cut, x.a AS l, y.a AS r, ((2000000::HUGEINT * c.a) // (x.a + y.a))::BIGINT AS score
        FROM cuts c JOIN often x ON x.lang = c.lang AND x.phrase = c.head JOIN often y ON y.lang = c.lang AND y.phrase = c.tail),
    lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
    longer AS (SELECT lang, phrase, max(a) AS a FROM ({inner}) GROUP BY lang, phrase),
    ranked AS (SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank
        FROM lowest s LEFT JOIN longer g ON g.lang = s.lang AND g.phrase = s.phrase WHERE g.a IS NULL OR 100::HUGEINT * g.a < 80::HUGEINT * s.a)
    SELECT lang, rank::INT AS rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing_sql(), "op9_exact_dedup": EXACT_SQL, "op11_url_filters": _url_sql(), "op12_phrases": _phrases_sql()}
