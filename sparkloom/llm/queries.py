"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .decontam import find_leaks
from .exact_dedup import exact_dedup
from .mixing import mix
from .near_dedup import near_components
from .pii import CONTEXT_BONUS, CONTEXT_CHARS, CONTEXT_WORDS, IBAN_LENGTHS, KINDS, PRIOR, THRESHOLD, find_pii, pii_digest
from . import secrets
from .secrets import find_secrets, secret_digest
from .sharding import assign_shards
from .toolcalls import REPLY, conversation_calls, link_calls
from .toxicity import toxicity
from .warc import round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(find_secrets(table(spark, sf_dir, "documents")))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents").select("doc_id"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(find_pii(table(spark, sf_dir, "documents")))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_calls(*conversation_calls(table(spark, sf_dir, "conversations")), REPLY)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_tool_calls": op1_tool_calls,
    "op2_warc": op2_warc,
    "op7_decontamination": op7_decontamination,
    "op5_toxicity": op5_toxicity,
    "op3_mixing": op3_mixing,
    "op4_exact_dedup": op4_exact_dedup,
    "op6_secrets": op6_secrets,
    "op8_sharding": op8_sharding,
    "op9_pii": op9_pii,
    "op10_minhash": op10_minhash,
}

def _places(text: str, pattern: str, of: str = "d") -> str:
    """(doc_id, t, s, m): the matches of a pattern and where they start, from the pieces between them."""
    return f"""(SELECT doc_id, t, xs[i] AS m, list_sum(list_transform(gs[1:i], lambda g: length(g)))::INT + coalesce(list_sum(list_transform(xs[1:i - 1], lambda x: length(x))), 0)::INT AS s
      FROM (SELECT *, unnest(range(1, len(xs) + 1)) AS i FROM (SELECT doc_id, t, regexp_extract_all({text}, '{pattern}') AS xs, regexp_split_to_array({text}, '{pattern}') AS gs FROM {of})))"""


def secrets_sql() -> str:
    """The base kinds, the battery on every long run, and the step-up over a document's runs."""
    assign = secrets.ASSIGN_RE.replace("'", "''")
    base = [
        f"SELECT doc_id, 0 AS k, s, s + length(m) AS e FROM {_places('t', assign)} WHERE length(regexp_extract(m, '{assign}', 2)) >= 6",
        f"SELECT doc_id, 1, s, s + length(m) FROM {_places('t', 'AKIA[A-Z0-9]{16,}')}",
        f"SELECT doc_id, 2, s, s + length(m) FROM {_places('t', '[0-9a-f]{24,}')}",
        "SELECT doc_id, 3, s, s + n FROM bh WHERE p <= most",
    ]
    fits = lambda a, name: f"translate(m, '{a}', '') = ''" + (" AND regexp_matches(m, '[0-9]')" if name.lower() == "base36" else "")
    alphabet = "CASE " + " ".join(f"WHEN {fits(a, n)} THEN '{a}'" for n, a in secrets.ALPHABETS.items()) + " END"
    tail = lambda z: f"least(1.0, 2 * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * (1 / (1 + 0.2316419 * abs({z}))) * {horner(z)})"

    def horner(z: str) -> str:
        t = f"(1 / (1 + 0.2316419 * abs({z})))"
        out = "1.330274429"
        for c in ("-1.821255978", "1.781477937", "-0.356563782", "0.319381530"):
            out = f"({c} + {t} * {out})"
        return out

    c = secrets.CELLS
    share = lambda j: f"((ceil(size * {j + 1} / {c}.0) - ceil(size * {j} / {c}.0)) / size)"
    x2 = " + ".join(f"pow(len(list_filter(r, lambda v: v * {c} // size = {j})) - n * {share(j)}, 2) / (n * {share(j)})" for j in range(c))
    df = c - 1
    names = f"{secrets.KINDS!r}[k + 1] || ':' || s || ':' || e"
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        t0 AS (SELECT doc_id, s, m, length(m)::DOUBLE AS n, {alphabet} AS a FROM {_places('t', f'[A-Za-z0-9+/_-]{{{secrets.MIN_TOKEN},}}')}),
        t1 AS (SELECT *, length(a)::DOUBLE AS size, list_transform(regexp_extract_all(m, '.'), lambda ch: strpos(a, ch) - 1) AS r FROM t0),
        t2 AS (SELECT *, list_transform(r, lambda v: (2 * v >= size)::INT) AS h, list_avg(r) AS mu FROM t1),
        t3 AS (SELECT *, list_sum(h)::DOUBLE AS n1, 1 + len(list_filter(range(2, len(h) + 1), lambda i: h[i] <> h[i - 1])) AS runs, list_transform(r, lambda v: v - mu) AS dev FROM t2),
        t4 AS (SELECT *, 2 * n1 * (n - n1) / n + 1 AS mean, list_sum(list_transform(dev, lambda v: v * v)) AS own, list_sum(list_transform(range(2, len(dev) + 1), lambda i: dev[i] * dev[i - 1])) AS cov,
                 (pow(({x2}) / {df}, 1.0 / 3) - (1 - 2.0 / {9 * df})) / sqrt(2.0 / {9 * df}) AS z FROM t3),
        t5 AS (SELECT *, (mean - 1) * (mean - 2) / (n - 1) AS var FROM t4),
        t6 AS (SELECT doc_id, s, n::INT AS n, CASE WHEN a IS NULL OR a = '0123456789' THEN 0 ELSE least(1.0, 3 * least(CASE WHEN z > 0 THEN {tail('z')} ELSE 1 END, CASE WHEN var > 0 THEN {tail('((runs - mean) / sqrt(var))')} ELSE 0 END,
                 CASE WHEN own > 0 THEN {tail('((cov / own + 1 / n) * sqrt(n))')} ELSE 0 END)) END AS x FROM t5),
        t7 AS (SELECT *, CASE WHEN x >= {secrets.ALPHA} THEN 1 - exp(pow(2, -{secrets.BITS_PER_CHAR} * n) * ln(x)) ELSE 1 END AS p FROM t6),
        t8 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS rank, count(*) OVER (PARTITION BY doc_id) AS of FROM t7),
        bh AS (SELECT *, max(CASE WHEN p <= {secrets.Q} * rank / of THEN p ELSE -1 END) OVER (PARTITION BY doc_id) AS most FROM t8),
        f AS ({' UNION ALL '.join(base)})
        SELECT d.doc_id, {', '.join(f'count(*) FILTER (WHERE k = {k}) AS n_{n}' for k, n in enumerate(secrets.KINDS[:3]))},
               sha256(coalesce(string_agg({names}, ',' ORDER BY s, k) FILTER (WHERE k < 3), '')) AS base_sha256, coalesce(string_agg({names}, ',' ORDER BY s, k), '') AS spans
        FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id"""


def pii_sql() -> str:
    """Matches by kind with their places, checks, and scores by the words around them.

    RE2 has no look-around: numbers of accounts are searched for where underscores stand as blanks, so that a
    word boundary is one of letters and digits, and what stands beside a tax number is tested after the match.
    """
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr({digits}, -i, 1)::INT WHEN substr({digits}, -i, 1)::INT > 4 THEN 2 * substr({digits}, -i, 1)::INT - 9 ELSE 2 * substr({digits}, -i, 1)::INT END)) % 10 = 0"
    bare = "replace(m, ' ', '')"
    mod97 = f"list_reduce(list_transform(regexp_extract_all(substr({bare}, 5) || substr({bare}, 1, 4), '.'), lambda c: CASE WHEN c <= '9' THEN c::INT ELSE unicode(c) - 55 END), lambda a, v: (CASE WHEN v > 9 THEN a * 100 ELSE a * 10 END + v) % 97, 0) = 1"
    ibans = "|".join(f"(?:{'|'.join(c for c, k in IBAN_LENGTHS.items() if k == n)})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n in sorted(set(IBAN_LENGTHS.values())))
    kinds = [
        ("t", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        ("t", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", r"len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(nullif(ltrim(p, '0'), '') AS INT), 0) > 255)) = 0"),
        ("t", r"[0-9](?:[\x20-]?[0-9])+", f"CASE WHEN length({digits}) BETWEEN 14 AND 19 THEN {luhn} ELSE false END"),
        ("t", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 10 AND 15"),
        ("replace(t, '_', ' ')", rf"\b(?:{ibans})\b", mod97),
        ("t", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "NOT regexp_matches(substr(t, greatest(s, 1), least(s, 1)) || ' ' || substr(t, e + 1, 1), '[0-9-]')"),
    ]
    found = []
    for k, (text, pattern, ok) in enumerate(kinds):
        words = f"regexp_matches(substr(t, greatest(s - {CONTEXT_CHARS}, 0) + 1, s - greatest(s - {CONTEXT_CHARS}, 0)) || ' ' || substr(t, e + 1, {CONTEXT_CHARS}), '(?i)(?:^|[^a-z])(?:{CONTEXT_WORDS[k]})(?:$|[^a-z])')"
        score = f"least(1.0, {PRIOR[k]} + CASE WHEN {words} THEN {CONTEXT_BONUS} ELSE 0.0 END)"
        found.append(f"SELECT doc_id, {k} AS k, s, e, {score} AS score FROM (SELECT *, s + length(m) AS e FROM {_places(text, pattern)}) WHERE {ok}" + (f" AND {score} >= {THRESHOLD}" if k > 3 else ""))
    name = f"{KINDS!r}[k + 1] || ':' || s || ':' || e"
    counts = ", ".join(f"count(*) FILTER (WHERE k = {k}) AS n_{n}" for k, n in enumerate(KINDS[:4]))
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({' UNION ALL '.join(found)})
        SELECT d.doc_id, {counts}, sha256(coalesce(string_agg({name}, ',' ORDER BY s, k) FILTER (WHERE k < 4), '')) AS base_sha256,
               coalesce(string_agg({name}, ',' ORDER BY s, k), '') AS spans, coalesce(string_agg(format('{{:.2f}}', score), ',' ORDER BY s, k), '') AS scores
        FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id"""


ORACLE = {
    "op1_tool_calls": r"""
        WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, '') AS role, text FROM conversations),
        callers AS (SELECT * FROM t WHERE role <> 'assistant'),
        calls AS (
          SELECT c.conv_id, 'call-' || c.turn AS call_id, c.turn, CASE WHEN c.role = 'user' THEN 'reply' ELSE 'instruct' END AS name,
                 CASE WHEN c.role = 'user' THEN 'prompt' ELSE 'text' END AS key, c.text, coalesce(a.turn, b.turn) AS before,
                 row_number() OVER (PARTITION BY c.conv_id, c.turn ORDER BY c.text) AS nth
          FROM callers c LEFT JOIN (SELECT DISTINCT conv_id, turn FROM callers) a ON a.conv_id = c.conv_id AND a.turn = c.turn - 1
          LEFT JOIN (SELECT DISTINCT conv_id, turn FROM callers WHERE role = 'user') b ON b.conv_id = c.conv_id AND b.turn = c.turn - 2),
        levels AS (
          SELECT DISTINCT conv_id, turn, 0 AS level FROM calls WHERE before IS NULL
          UNION ALL
          SELECT n.conv_id, n.turn, level + 1 FROM (SELECT DISTINCT conv_id, turn, before FROM calls) n JOIN levels l ON n.conv_id = l.conv_id AND n.before = l.turn),
        results AS (
          SELECT conv_id, 'call-' || (turn - 1) AS call_id, turn, text AS content, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS nth
          FROM t WHERE role = 'assistant')
        SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, coalesce(c.nth, r.nth) AS nth, c.turn, r.turn AS result_turn, c.name,
               CASE WHEN c.turn IS NULL THEN 'orphan result' WHEN r.turn IS NULL THEN 'open' WHEN c.nth > 1 THEN 'extra' ELSE 'linked' END AS status,
               CASE WHEN c.turn IS NULL THEN NULL WHEN c.text IS NULL THEN 'missing ' || c.key WHEN c.text = '' THEN 'length of ' || c.key ELSE 'ok' END AS arguments_ok,
               '{"arguments":' || CASE WHEN c.turn IS NULL THEN 'null' ELSE '{' || CASE WHEN c.text IS NULL THEN '' ELSE '"' || c.key || '":' || to_json(c.text) || ',' END || '"turn":' || c.turn || '}' END
                 || ',"call":"' || coalesce(c.call_id, r.call_id) || '","conversation":' || coalesce(c.conv_id, r.conv_id) || ',"name":' || coalesce('"' || c.name || '"', 'null')
                 || ',"result":' || coalesce(to_json(r.content)::VARCHAR, 'null') || '}' AS json, l.level::INT AS level
        FROM calls c FULL JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id AND c.nth = r.nth
        LEFT JOIN levels l ON l.conv_id = c.conv_id AND l.turn = c.turn
    """,
    "op2_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
        w AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, h, row_number() OVER same AS r, first_value(page_id) OVER same AS first FROM p
              WINDOW same AS (PARTITION BY html ORDER BY page_id NULLS LAST))
        SELECT page_id, payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 ((('0x' || substr(h, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN r = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN r > 1 THEN first END AS refers_to
        FROM w
    """,
    "op6_secrets": secrets_sql(),
    "op9_pii": pii_sql(),
    "op10_minhash": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS (
          SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w
        ), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s
        ), b AS (
          SELECT p.doc_id AS a, q.doc_id AS b FROM e p JOIN e q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY p.doc_id, q.doc_id
          HAVING 100 * count(*) >= 75 * (any_value(p.n) + any_value(q.n) - count(*))
        ), r AS (SELECT doc_id, doc_id AS t FROM documents UNION SELECT r.doc_id, b.b FROM r JOIN b ON r.t = b.a)
        SELECT doc_id, len(s.s)::BIGINT AS n_shingles, c.c AS component_id, doc_id = c.c AS kept FROM s JOIN (SELECT doc_id, min(t) AS c FROM r GROUP BY doc_id) c USING (doc_id)
    """,
    "op4_exact_dedup": r"""
        WITH t AS (
          SELECT doc_id, length(coalesce(text, '')) AS c, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
          FROM documents
        ), w AS (
          SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY c DESC, doc_id) AS keep_id,
                 count(*) OVER (PARTITION BY text_sha256) AS group_size
          FROM t
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
    """,
}
