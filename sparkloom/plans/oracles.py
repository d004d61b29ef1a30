"""DuckDB SQL of the registered queries, from fragments that state the same rules in SQL.

RE2 has no look-around and no back-references, and ``length`` counts code points as Spark's does.
"""

from __future__ import annotations

import json

from ..functions import chars, clean, rules
from ..operators import align, dialogue, quality, rewriting
from ..sources import feeds
from . import fixtures as X
from . import lessons

SP = r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
SPC = SP[1:-1]
NUM = r"[0-9][0-9,]*(?:\.[0-9]+)?%?"


def q(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(q, v)) + "]"
    return "'" + v.replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows) + f") AS v({names})"


def sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def trim(x: str) -> str:
    return sub(x, f"^{SP}+|{SP}+$")


def squeeze(x: str) -> str:
    return trim(sub(x, f"{SP}+", " "))


def hits(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({x}, {q(pattern)}, {group})"


def n_hits(x: str, pattern: str) -> str:
    return f"len({hits(x, pattern)})"


def let(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def joined(xs: str, by: str = "") -> str:
    return f"array_to_string({xs}, {q(by)})"


def decode(x: str) -> str:
    for name, text in clean.ENTITIES:
        x = f"replace({x}, {q(name)}, {q(text)})"
    return x


def no_tags(x: str) -> str:
    return sub(x, "<[^>]+>", " ")


def no_cdata(x: str) -> str:
    return sub(x, r"(?s)<!\[CDATA\[(.*?)\]\]>", r"\1")


def clean_text(x: str) -> str:
    return squeeze(sub(sub(decode(no_tags(no_cdata(x))), r"(?s)\s*編輯\s*[:：].*$"), r"(?s)\s*記者\s*[:：].*$"))


def blank_line_paragraphs(x: str) -> str:
    return joined(f"list_filter(list_transform(regexp_split_to_array({x}, '\\n{{2,}}'), lambda p: {squeeze('p')}), lambda p: p <> '')", "\n\n")


def clean_html_body(x: str) -> str:
    x = sub(sub(no_cdata(x), r"(?i)<br\s*/?>", "\n"), r"(?i)</(?:p|div|li|h[1-6]|section)>", "\n\n")
    for tag in ("script", "style"):
        x = sub(x, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    return blank_line_paragraphs(decode(no_tags(x)))


def container_body(x: str) -> str:
    x = f"regexp_extract({x}, {q(r'(?is)class=\"itemFullText\"[^>]*>(.*?)</div>')}, 1)"
    x = decode(no_tags(sub(sub(x, r"(?i)<br\s*/?>", "\n"), r"(?i)</(?:p|div|li)>", "\n")))
    return blank_line_paragraphs(sub(sub(x, r"(?s)\s*編輯\s*[:：].*$"), r"(?s)\s*記者\s*[:：].*$"))


def junk(x: str) -> str:
    patterns = [j.replace("(?<![A-Za-z0-9_])", r"\b").replace("(?![A-Za-z0-9_])", r"\b").replace(r"\z", "$") for j in clean.JUNK]
    return let(trim(x), "tj", "tj = '' OR " + " OR ".join(f"regexp_matches(tj, {q(j)})" for j in patterns))


def count(x: str, p: chars.ScriptProfile) -> str:
    return n_hits(x, f"[{p.letters}]")


def fraction(x: str, p: chars.ScriptProfile) -> str:
    letters = n_hits(x, rf"[\p{{L}}{p.letters}]")
    return f"CASE WHEN {letters} > 0 THEN {count(x, p)}::DOUBLE / {letters} ELSE 0.0 END"


def density(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN 0 ELSE ({n_hits(x, '[0-9]')} + {n_hits(x, '%|百分')})::DOUBLE / length({x}) END"


def studyable(x: str, p: chars.ScriptProfile, least: int | None = None) -> str:
    return f"({fraction(x, p)} >= {p.min_fraction} AND {count(x, p)} >= {p.min_chars if least is None else least})"


def news_score(x: str) -> str:
    return f"({n_hits(x, '|'.join(chars.NEWS_WORDS))} * 3 - {n_hits(x, '|'.join(chars.REPORT_WORDS) + '|報[0-9]')} * 1.5 - 20 * ({density(x)}))"


def sentences(x: str, p: chars.ScriptProfile) -> str:
    b = p.breakers
    return f"list_filter(list_transform({hits(x, rf'[^\n{b}]*[{b}]+|[^\n{b}]+')}, lambda s: {trim('s')}), lambda s: s <> '')"


def paragraphs(x: str, p: chars.ScriptProfile) -> str:
    own = f"list_filter(list_transform(regexp_split_to_array({x}, {q(p.paragraph)}), lambda pp: {trim('pp')}), lambda pp: pp <> '')"
    return let(own, "ps", f"CASE WHEN len(ps) > 0 THEN ps ELSE list_filter([{trim(x)}], lambda pp: pp <> '') END")


def pack(x: str, p: chars.ScriptProfile, least: int = 7, most: int = 15) -> str:
    one = f"list_transform({sentences(x, p)}, lambda s: [{{'text': s, 'chars': {count('s', p)}::INT}}])"
    grown = "list_append(a[1:len(a) - 1], {'text': a[len(a)].text || b[1].text, 'chars': (a[len(a)].chars + b[1].chars)::INT})"
    step = f"CASE WHEN a[len(a)].chars < {least} AND a[len(a)].chars + b[1].chars <= {most} THEN {grown} ELSE list_concat(a, b) END"
    return let(one, "us", f"CASE WHEN len(us) = 0 THEN [] ELSE list_reduce(us, lambda a, b: {step}) END")


def rule_tokens(x: str) -> str:
    return hits(x, rules.token_pattern(rules.STARTER).replace(r"[\s\S]", r"(?s:.)"))


def rule_pairs(x: str) -> str:
    """Each token with its spoken form."""
    table = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in rules.STARTER.items()) + "}"
    past = "CASE WHEN coalesce(substr(ts[i + 1], 1, 1), '') IN ('', '。', '！', '？') THEN '喇' ELSE '咗' END"
    return let(rule_tokens(x), "ts", f"list_transform(ts, lambda tk, i: {{'f': tk, 'c': CASE WHEN tk = '了' THEN {past} ELSE coalesce({table}[tk], tk) END}})")


def loaded_rules(x: str, rows: str) -> str:
    """Texts by the landed rules: of equal keys the strongest kind, then the longest key first."""
    kinds = "CASE kind WHEN 'protect' THEN 3 WHEN 'phrase' THEN 2 ELSE 1 END"
    table = f"(SELECT k, arg_max(CASE WHEN kind = 'protect' THEN k ELSE v END, {kinds}) AS v FROM {values(X.RULES, 'k, v, kind')} WHERE k <> '' GROUP BY k)"
    keys = "|".join(sorted({k for k, _, _ in X.RULES if k}, key=lambda k: (-len(k), k)))
    tokens = hits(x, f"「[^」]*」?|《[^》]*》?|『[^』]*』?|{keys}|(?s:.)")
    past = "CASE WHEN coalesce(substr(ts[i + 1], 1, 1), '') IN ('', '。', '！', '？') THEN '喇' ELSE '咗' END"
    one = f"CASE WHEN tk = '了' THEN {past} ELSE coalesce(mm[tk], tk) END"
    return f"SELECT id, array_to_string({let(tokens, 'ts', f'list_transform(ts, lambda tk, i: {one})')}, '') AS colloquial FROM {rows}, (SELECT map(list(k ORDER BY k), list(v ORDER BY k)) AS mm FROM {table})"


def rule_segments(x: str) -> str:
    """Unchanged tokens beside each other are one segment."""
    begins = "list_filter(range(1, len(rp) + 1), lambda i: i = 1 OR rp[i].f <> rp[i].c OR rp[i - 1].f <> rp[i - 1].c)"
    side = lambda k: f"array_to_string(list_transform(rp[s:coalesce(st[k + 1], len(rp) + 1) - 1], lambda z: z.{k}), '')"
    return let(rule_pairs(x), "rp", let(begins, "st", f"list_transform(st, lambda s, k: {{'f': {side('f')}, 'c': {side('c')}}})"))


def digits(x: str) -> str:
    return f"translate({x}, '0123456789', '零一二三四五六七八九')"


def _section(four: str) -> str:
    places = " || ".join(f"CASE substr({four}, {i}, 1) WHEN '0' THEN '零' ELSE {digits(f'substr({four}, {i}, 1)')} || '{u}' END" for i, u in enumerate("千百十", 1))
    return sub(sub(f"{places} || {digits(f'substr({four}, 4, 1)')}", "零+", "零"), "零$")


def cardinal(x: str) -> str:
    parts = " || ".join(f"CASE WHEN substr(w, {4 * i + 1}, 4) = '0000' THEN '零' ELSE {_section(f'substr(w, {4 * i + 1}, 4)')} || '{u}' END" for i, u in enumerate(["兆", "億", "萬", ""]))
    read = sub(sub(sub(parts, "零+", "零"), "^零|零$"), "^一十", "十")
    bare = f"CASE WHEN ltrim({x}, '0') = '' THEN '0' ELSE ltrim({x}, '0') END"
    return let(bare, "nn", f"CASE WHEN nn = '0' THEN '零' WHEN length(nn) > 16 THEN {digits('nn')} ELSE {let("lpad(nn, 16, '0')", 'w', read)} END")


def normalize_digits(x: str) -> str:
    x = f"translate({x}, '０１２３４５６７８９', '0123456789')"
    # Twice, as a match takes the digit that the next one would begin with.
    for mark, to in (("，", ","), ("．", ".")):
        x = sub(sub(x, f"([0-9]){mark}([0-9])", rf"\1{to}\2"), f"([0-9]){mark}([0-9])", rf"\1{to}\2")
    return sub(x, "([0-9])％", r"\1%")


def _year(f: str) -> str:
    j = rf"^[ 　]*[至到–－~～\-]({SP}*)[0-9][0-9,]*"
    after = f"substr(regexp_extract({f}, {q('(?s)' + j + '(.*)')}, 2), length(regexp_extract({f}, {q(j)}, 1)) + 1)"
    return f"(regexp_matches({f}, '^[ 　]*年') OR (regexp_matches({f}, {q(j)}) AND regexp_matches({after}, '^[ 　]*年')))"


def _read_number(n: str, f: str) -> str:
    bare = f"replace({sub(n, '%$')}, ',', '')"
    value = cardinal("split_part(bb, '.', 1)") + " || CASE WHEN contains(bb, '.') THEN '點' || " + digits("split_part(bb, '.', 2)") + " ELSE '' END"
    comma = f"contains({n}, ',')"
    read = f"CASE WHEN suffix({n}, '%') THEN '百分之' || vv WHEN contains(bb, '.') THEN vv WHEN length(bb) >= 3 AND NOT {comma} AND {_year(f)} THEN {digits('bb')} WHEN length(bb) >= 8 AND NOT {comma} THEN {digits('bb')} ELSE vv END"
    return let(bare, "bb", let(value, "vv", read))


def spell(x: str, lookahead: str = "''") -> str:
    """Every number of a text read by what surrounds it."""
    rest = f"array_to_string(list_transform(range(i + 1, len(sx.g) + 1), lambda k: sx.g[k] || coalesce(sx.m[k], '')), '') || {lookahead}"
    coded = "regexp_matches(sx.g[i], '[:：]$') AND NOT regexp_matches(m, '[.%]')"
    second = f"i > 1 AND regexp_matches(m, '^[0-9]{{1,2}}$') AND regexp_matches(sx.g[i], {q(f'^{SP}*[至到–—－~～-]{SP}*$')}) AND regexp_matches(sx.m[i - 1], '[0-9]{{3}}$') AND regexp_matches(ff, '^[ 　]*年')"
    one = let(rest, "ff", f"sx.g[i] || CASE WHEN ({coded}) OR ({second}) THEN {digits("replace(m, ',', '')")} ELSE {_read_number('m', 'ff')} END")
    parts = f"{{'g': regexp_split_to_array({x}, {q(NUM)}), 'm': {hits(x, NUM)}}}"
    whole = f"array_to_string(list_transform(sx.m, lambda m, i: {one}), '') || sx.g[len(sx.g)]"
    return f"CASE WHEN regexp_matches({x}, '[0-9]') THEN {let(parts, 'sx', whole)} ELSE {x} END"


def spell_pairs(pairs: str) -> str:
    """Segments spelled out, unchanged ones split around their numbers first."""
    apart = f"flatten(list_transform({pairs}, lambda sp: CASE WHEN sp.f = sp.c AND regexp_matches(sp.f, '[0-9]') THEN list_transform({hits('sp.f', NUM + '|[^0-9]+')}, lambda tk: {{'f': tk, 'c': tk}}) ELSE [sp] END))"
    later = "array_to_string(list_transform(ap[j + 1:], lambda z: z.c), '')"
    return let(apart, "ap", f"list_transform(ap, lambda sp, j: {{'f': sp.f, 'c': {spell('sp.c', later)}}})")


def spoken(pairs: str) -> str:
    return f"array_to_string(list_transform({pairs}, lambda z: z.c), '')"


def page_paragraphs(html: str) -> str:
    x = html
    for tag in ("script", "style", "noscript"):
        x = sub(x, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    return f"list_transform({hits(x, '(?is)<p[^>]*>(.*?)</p>', 1)}, lambda pg: {squeeze(decode(no_tags('pg')))})"


def utf16(x: str) -> str:
    return f"(length({x}) + {n_hits(x, '[\\x{10000}-\\x{10FFFF}]')})"


def prose(html: str, p: chars.ScriptProfile, least: int = 12, most: int = 1600) -> str:
    cjk = f"[{chars.CJK}]"
    gaps = f"len(list_filter(range(2, length(x)), lambda i: substr(x, i, 1) = ' ' AND regexp_matches(substr(x, i - 1, 1), {q(cjk)}) AND regexp_matches(substr(x, i + 1, 1), {q(cjk)})))"
    good = f"CASE WHEN {count('x', p)} < {least} OR {count('x', p)} < 0.4 * {utf16('x')} OR NOT regexp_matches(x, {q(f'[{p.prose}]')}) THEN false WHEN regexp_matches(x, {q(cjk)}) AND {gaps} >= 3 THEN false ELSE NOT {junk('x')} END"
    kept = f"list_filter({page_paragraphs(html)}, lambda x: {good})"
    before = f"coalesce(list_sum(list_transform(xs[1:k - 1], lambda y: {utf16('y')})), 0)"
    return let(kept, "xs", f"list_filter(xs, lambda x, k: {before} <= {most})")


def items(feed: str) -> str:
    """(feed_ord, source, item_ord, title, link, description, content, published) of (feed_ord, source, xml)."""
    tag = lambda n: f"regexp_extract(x, {q(rf'(?is)<{n}[^>]*>(.*?)</{n}>')}, 1)"
    return f"""(SELECT feed_ord, source, item_ord, {clean_text(tag('title'))} AS title, {clean_text(tag('link'))} AS link, {clean_text(tag('description'))} AS description,
      {clean_html_body(tag('content:encoded'))} AS content, {clean_text(tag('pubDate'))} AS published
      FROM (SELECT feed_ord, source, i - 1 AS item_ord, xs[i] AS x FROM (SELECT *, unnest(range(1, len(xs) + 1)) AS i FROM (SELECT feed_ord, source, {hits('xml', '(?is)<item.*?</item>')} AS xs FROM {feed} WHERE xml IS NOT NULL))))"""


def host(x: str) -> str:
    return f"lower(nullif(regexp_extract({x}, '^[a-zA-Z]+://([^/:?#]+)', 1), ''))"


def han(x: str) -> str:
    return f"replace(translate({x}, {q(X.HAN_FROM)}, {q(X.HAN_TO)}), ' ', '')"


L, H = chars.LATIN, chars.HAN
_FEEDS = values(X.XML, "feed_ord, source, xml")
_ITEMS = items(_FEEDS)
_STUDIED = f"(SELECT *, row_number() OVER (PARTITION BY feed_ord ORDER BY item_ord) AS r FROM (SELECT *, description AS body FROM {_ITEMS}) WHERE {studyable('body', H)})"
_PRIMARY = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(nullif(link, ''), title) ORDER BY feed_ord, item_ord) AS first FROM {_STUDIED} WHERE r <= 8) WHERE first = 1)"


def _units_of(rows: str, key: str, text: str, p: chars.ScriptProfile) -> str:
    """(key, paragraph_id, unit_id, formal, chars)."""
    paras = f"(SELECT {key}, unnest(range(1, len(ps) + 1)) - 1 AS paragraph_id, unnest(ps) AS x FROM (SELECT {key}, {paragraphs(text, p)} AS ps FROM {rows}))"
    return f"(SELECT {key}, paragraph_id::INT AS paragraph_id, unnest(range(1, len(us) + 1))::INT - 1 AS unit_id, unnest(us).text AS formal, unnest(us).chars AS chars FROM (SELECT {key}, paragraph_id, {pack('x', p)} AS us FROM {paras}))"


def _digest_units(rows: str, key: str) -> str:
    return f"SELECT {key}, count(*) AS units, sum(chars)::BIGINT AS letters, md5(string_agg(formal, '|' ORDER BY paragraph_id, unit_id)) AS digest FROM {rows} GROUP BY {key}"


SPELL_TABLE = [  # texts around the numbers of orders: n the key, m the customer
    "{n}年", "賣出{n}個", "{n}至{m}年", "編號：{n}", "升{n}%", "報{n}.{m}", "{n} 至 {m}年", "{n},{m}人", "熱線{n}{m}", "{n}至{s}年度", "由{n}年至{s}年",
]


def order_text() -> str:
    """The text of an order, in SQL that both engines read."""
    parts = []
    for i, t in enumerate(SPELL_TABLE):
        pieces = [x for x in t.replace("{", "\x00{").replace("}", "}\x00").split("\x00") if x]
        names = {"{n}": "CAST(o_orderkey AS STRING)", "{m}": "CAST(o_custkey AS STRING)", "{s}": "CAST(o_orderkey % 90 AS STRING)"}
        parts.append(f"WHEN {i} THEN concat({', '.join(names.get(x) or q(x) for x in pieces)})")
    return f"CASE CAST(o_orderkey % {len(SPELL_TABLE)} AS INT) {' '.join(parts)} END"


def _grade() -> str:
    """Least-edit paths by a row of distances after another, walked back from the end."""
    table = "MAP {" + ", ".join(f"{q(c)}: {q(r)}" for c, r in X.READINGS) + "}"
    written = f"translate(translate({{}}, {q(align.SPOKEN)}, {q(align.WRITTEN)}), {q(X.SCRIPT[0])}, {q(X.SCRIPT[1])})"
    only = lambda x: sub(x, f"[^{chars.CJK}]")
    shared = f"coalesce(list_has_any(coalesce({table}[translate(tc, {q(X.SCRIPT[1])}, {q(X.SCRIPT[0])})], {table}[tc]), coalesce({table}[translate(hc, {q(X.SCRIPT[1])}, {q(X.SCRIPT[0])})], {table}[hc])), false)"
    return f"""
      WITH RECURSIVE s AS (SELECT id, {only('t')} AS t, {only(spell('h'))} AS h FROM {values(X.ATTEMPTS, 'id, t, h')}),
      c AS (SELECT *, {written.format('t')} AS a, {written.format('h')} AS b FROM s),
      d AS (
        SELECT id, a, b, 0 AS i, range(0, length(b) + 1)::INT[] AS row FROM c
        UNION ALL
        SELECT id, a, b, i + 1, CASE WHEN b = '' THEN [i + 1]::INT[] ELSE list_reduce(list_transform(range(1, length(b) + 1), lambda j: [j::INT]),
          lambda acc, j: list_append(acc, least(row[j[1]] + CASE WHEN substr(a, i + 1, 1) = substr(b, j[1], 1) THEN 0 ELSE 1 END, row[j[1] + 1] + 1, acc[len(acc)] + 1)::INT), [(i + 1)::INT]) END
        FROM d WHERE i < length(a)),
      w AS (
        SELECT id, length(a) AS i, length(b) AS j, -1 AS ti, -1 AS hj FROM c
        UNION ALL
        SELECT w.id, CASE WHEN diag OR del THEN w.i - 1 ELSE w.i END, CASE WHEN diag THEN w.j - 1 WHEN del THEN w.j ELSE w.j - 1 END, CASE WHEN diag OR del THEN w.i ELSE -1 END, CASE WHEN diag THEN w.j ELSE -1 END
        FROM (SELECT w.*, w.i > 0 AND w.j > 0 AND n.row[w.j + 1] = p.row[w.j] + CASE WHEN substr(n.a, w.i, 1) = substr(n.b, w.j, 1) THEN 0 ELSE 1 END AS diag,
                     w.i > 0 AND (w.j = 0 OR n.row[w.j + 1] = p.row[w.j + 1] + 1) AS del
              FROM w JOIN d n ON n.id = w.id AND n.i = w.i LEFT JOIN d p ON p.id = w.id AND p.i = w.i - 1 WHERE w.i > 0 OR w.j > 0) w),
      m AS (SELECT w.id, ti, substr(t, ti, 1) AS tc, CASE WHEN hj > 0 THEN substr(h, hj, 1) END AS hc, coalesce(hj > 0 AND substr(a, ti, 1) = substr(b, hj, 1), false) AS ok FROM w JOIN c USING (id) WHERE ti > 0),
      k AS (SELECT *, NOT ok AND {shared} AS sound FROM m)
      SELECT s.id, round(coalesce(avg(CASE WHEN ok OR sound THEN 1.0 ELSE 0.0 END), 0), 4)::DOUBLE AS accuracy, CASE WHEN floor(coalesce(avg(CASE WHEN ok OR sound THEN 1.0 ELSE 0.0 END), 0) * 100 + 0.5) >= 80 THEN 'good' ELSE 'mid' END AS band,
             any_value(s.h) AS heard, coalesce(string_agg(CASE WHEN ok THEN 'ok' WHEN sound THEN 'soft' ELSE 'bad' END, ',' ORDER BY ti) FILTER (WHERE ti IS NOT NULL), '') AS marks
      FROM s LEFT JOIN k USING (id) GROUP BY s.id"""


def _json_list(x: str, path: str, kind: str) -> str:
    return f"from_json(json_extract({x}, '$.{path}'), '{kind}')"


def _reply(content: str, refused: str) -> str:
    inside = f"CASE WHEN regexp_matches({content}, '(?is)```(?:json)?\\s*.*?\\s*```') THEN regexp_extract({content}, '(?is)```(?:json)?\\s*(.*?)\\s*```', 1) ELSE {content} END"
    found = f"regexp_extract({inside}, '(?s)\\{{.*\\}}')"
    return f"CASE WHEN NOT {refused} AND json_valid({found}) THEN {found}::JSON END"


_PAIR = '[{"f":"VARCHAR","c":"VARCHAR"}]'
_SPOKEN = lambda x: normalize_digits(trim(f"coalesce({x}, '')"))


def _pairs_ok(pairs: str, f: str, c: str) -> str:
    full = f"list_filter(list_transform({pairs}, lambda z: {{'f': coalesce(z.f, ''), 'c': {normalize_digits("coalesce(z.c, '')")}}}), lambda z: z.f <> '' OR z.c <> '')"
    return let(full, "pf", f"CASE WHEN len(pf) > 0 AND array_to_string(list_transform(pf, lambda z: z.f), '') = {f} AND array_to_string(list_transform(pf, lambda z: z.c), '') = {c} THEN pf END")


def _tier1() -> str:
    """CTEs: u units, r1 rewrites of whole articles, t1 with verdicts."""
    reply = values([r[:2] + (r[3], r[4]) for r in X.REWRITTEN], "article_id, batch_id, content, refused")
    verdict = values([r[:2] + (r[3], r[4]) for r in X.VERDICTS], "article_id, batch_id, content, refused")
    return f"""u AS (SELECT *, unit_id // 2 AS batch_id, unit_id % 2 AS place, count(*) OVER (PARTITION BY article_id, unit_id // 2) AS n FROM {values(X.UNITS, 'article_id, unit_id, formal')}),
      r0 AS (SELECT article_id, batch_id, from_json(json_extract({_reply('content', 'refused')}, '$.sentences'), '[{{"colloquial":"VARCHAR","pairs":{_PAIR}}}]') AS xs FROM {reply}),
      r1 AS (SELECT u.*, coalesce(len(xs) = n, false) AS whole, xs[place + 1] AS said FROM u LEFT JOIN r0 USING (article_id, batch_id)),
      r2 AS (SELECT * FROM (SELECT *, bool_and(whole) OVER (PARTITION BY article_id) AS good, {_SPOKEN('said.colloquial')} AS c FROM r1) WHERE good),
      r3 AS MATERIALIZED (SELECT article_id, unit_id, batch_id, place, n, formal, CASE WHEN c = '' THEN formal ELSE c END AS colloquial, CASE WHEN c <> '' THEN {_pairs_ok('said.pairs', 'formal', 'c')} END AS pairs FROM r2),
      v0 AS (SELECT article_id, batch_id, from_json(json_extract({_reply('content', 'refused')}, '$.verdicts'), '[{{"ok":"BOOLEAN","fixed":"VARCHAR","fixed_pairs":{_PAIR}}}]') AS xs FROM {verdict}),
      v1 AS (SELECT r3.*, coalesce(len(xs) = n, false) AS whole, xs[place + 1] AS said FROM r3 LEFT JOIN v0 USING (article_id, batch_id)),
      v2 AS (SELECT *, bool_and(whole) OVER (PARTITION BY article_id) AS verified, CASE WHEN said.ok THEN '' ELSE {_SPOKEN('said.fixed')} END AS fix FROM v1),
      t1 AS MATERIALIZED (SELECT article_id, unit_id, CASE WHEN verified AND fix <> '' THEN fix ELSE colloquial END AS colloquial, CASE WHEN verified AND fix <> '' THEN {_pairs_ok('said.fixed_pairs', 'formal', 'fix')} ELSE pairs END AS pairs,
               verified, verified AND fix <> '' AS repaired FROM v2)"""


def _tier2() -> str:
    reply = values([(a, b, {"big": 1, "small": 2}.get(m, 0), c, r) for a, b, m, c, r in X.PLAIN_REPLIES], "article_id, batch_id, rank, content, refused")
    review = values([r[:2] + (r[3], r[4]) for r in X.REVIEWS], "article_id, batch_id, content, refused")
    return f"""u2 AS (SELECT *, unit_id // 2 AS batch_id, unit_id % 2 AS place, count(*) OVER (PARTITION BY article_id, unit_id // 2) AS n FROM {values(X.UNITS, 'article_id, unit_id, formal')}),
      n2 AS (SELECT DISTINCT article_id, batch_id, n FROM u2),
      p2 AS (SELECT article_id, batch_id, rank, n, from_json(json_extract({_reply('content', 'refused')}, '$.sentences'), '["VARCHAR"]') AS xs FROM {reply} JOIN n2 USING (article_id, batch_id)),
      b2 AS (SELECT article_id, batch_id, arg_min(xs, rank) AS xs FROM p2 WHERE rank > 0 AND len(xs) = n GROUP BY ALL),
      w2 AS (SELECT article_id, batch_id, xs AS ys FROM (SELECT article_id, batch_id, n, from_json(json_extract({_reply('content', 'refused')}, '$.sentences'), '["VARCHAR"]') AS xs FROM {review} JOIN n2 USING (article_id, batch_id)) WHERE len(xs) = n),
      t2 AS MATERIALIZED (SELECT article_id, unit_id, CASE WHEN y <> '' THEN y WHEN x <> '' THEN x ELSE formal END AS colloquial FROM (
        SELECT article_id, unit_id, formal, {_SPOKEN('xs[place + 1]')} AS x, {_SPOKEN('ys[place + 1]')} AS y, bool_and(xs IS NOT NULL) OVER (PARTITION BY article_id) AS good
        FROM u2 LEFT JOIN b2 USING (article_id, batch_id) LEFT JOIN w2 USING (article_id, batch_id)) WHERE good)"""


_SAID = f"""s0 AS MATERIALIZED (SELECT u.article_id, u.unit_id, u.formal, t1.colloquial AS c1, t1.pairs AS p1, t1.verified AS v, t1.repaired AS r, t2.colloquial AS c2 FROM u LEFT JOIN t1 USING (article_id, unit_id) LEFT JOIN t2 USING (article_id, unit_id)),
      s1 AS MATERIALIZED (SELECT *, CASE WHEN c1 IS NOT NULL AND p1 IS NOT NULL THEN {spoken(spell_pairs('p1'))} WHEN c1 IS NOT NULL THEN {spell('c1')} WHEN c2 IS NULL OR c2 = formal THEN {spoken(spell_pairs(rule_segments('formal')))} ELSE {spell('c2')} END AS said,
               CASE WHEN c1 IS NOT NULL AND v THEN 'llm+verify' WHEN c1 IS NOT NULL OR c2 IS NOT NULL THEN 'llm' ELSE 'rules' END AS method FROM s0)"""
_TIERS = f"WITH {_tier1()}, {_tier2()}, {_SAID}"
_JYUTPING = "array_to_string(list_transform(regexp_extract_all(said, '(?s).'), lambda ch: coalesce(MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in X.SPOKEN_READINGS.items()) + "}[ch], '')), ' ')"

_SRC = f"(SELECT unnest(from_json({q(json.dumps(X.CURRICULUM, ensure_ascii=False))}::JSON->'$.categories', '[{{\"id\":\"VARCHAR\",\"emoji\":\"VARCHAR\",\"title\":{{\"en\":\"VARCHAR\",\"hant\":\"VARCHAR\",\"hans\":\"VARCHAR\"}},\"scenarios\":[{{\"id\":\"VARCHAR\",\"emoji\":\"VARCHAR\",\"level\":\"INTEGER\",\"title\":{{\"en\":\"VARCHAR\",\"hant\":\"VARCHAR\",\"hans\":\"VARCHAR\"}},\"lines\":[{{\"speaker\":\"VARCHAR\",\"formal\":\"VARCHAR\",\"colloquial\":\"VARCHAR\",\"en\":\"VARCHAR\"}}]}}]}}]')) AS c)"
_SCEN = f"(SELECT coalesce(c.id, '?') AS cat, c.title AS cat_title, unnest(c.scenarios) AS s FROM {_SRC})"
_LINES = f"(SELECT cat, s.id AS sid, i - 1 AS i, s.lines[i] AS x FROM (SELECT *, unnest(range(1, len(s.lines) + 1)) AS i FROM {_SCEN}))"
_TITLED = lambda t: f"(coalesce({t}.en, '') <> '' AND coalesce({t}.hant, '') <> '' AND coalesce({t}.hans, '') <> '')"


def _rules(of: str, place: str, checks: dict[str, str]) -> str:
    """(place, rule) of rows that fail a check."""
    return " UNION ALL ".join(f"SELECT {place} AS place, {q(rule)} AS rule FROM {of} WHERE NOT coalesce({ok}, false)" for rule, ok in checks.items())


def _sentence_checks(f: str, c: str, j: str, p: str | None) -> dict[str, str]:
    cjk = f"[{chars.CJK}]"
    chs = f"regexp_extract_all({c}, '(?s).')"
    n = f"len({j}) = length({c})"
    syl = f"CASE WHEN {n} THEN len(list_filter(range(1, length({c}) + 1), lambda i: regexp_matches({chs}[i], {q(cjk)}) <> ({j}[i] <> ''))) = 0 ELSE false END"
    pairs = "true" if p is None else f"{p} IS NULL OR (len({p}) > 0 AND array_to_string(list_transform({p}, lambda z: z.f), '') = {f} AND array_to_string(list_transform({p}, lambda z: z.c), '') = {c})"
    return {"formal": f"coalesce({f}, '') <> ''", "colloquial": f"coalesce({c}, '') <> ''", "jyutping-length": n, "jyutping-syllables": syl, "pairs": pairs}


_QUALITY = "(SELECT id, f, c, from_json(j::JSON, '[\"VARCHAR\"]') AS j, from_json(p::JSON, '[{\"f\":\"VARCHAR\",\"c\":\"VARCHAR\"}]') AS p FROM " + values(
    [(i, f, c, None if j is None else json.dumps(j, ensure_ascii=False), None if p is None else json.dumps([{"f": a, "c": b} for a, b in p], ensure_ascii=False)) for i, f, c, j, p in X.QUALITY], "id, f, c, j, p") + ")"

_CHOSEN = f"""
  p0 AS (SELECT * FROM {values(X.CANDIDATES, 'ord, title, body, url, published, source')}),
  s0 AS (SELECT * FROM {values(X.SECONDARY, 'ord, title, body, url, published, source')}),
  p1 AS (SELECT * REPLACE (array_to_string(list_filter(regexp_split_to_array(body, '\\n{{2,}}'), lambda x: NOT {junk('x')}), chr(10) || chr(10)) AS body) FROM p0),
  s1 AS (SELECT * REPLACE (array_to_string(list_filter(regexp_split_to_array(body, '\\n{{2,}}'), lambda x: NOT {junk('x')}), chr(10) || chr(10)) AS body) FROM s0),
  p2 AS (SELECT *, {count('body', H)} AS n FROM p1),
  p3 AS (SELECT * FROM p2 WHERE n >= CASE WHEN (SELECT count(*) FROM p2 WHERE n >= 80) >= 6 THEN 80 ELSE 20 END),
  p4 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {news_score("title || ' ' || body")} DESC, ord) AS rk, min(ord) OVER (PARTITION BY source) AS so FROM p3),
  s2 AS (SELECT * FROM s1 WHERE {count('body', H)} >= 40 ORDER BY ord LIMIT 4),
  c0 AS (SELECT 0 AS lane, 0 AS rk, 0 AS so, ord, title, body, url, source FROM s2 UNION ALL (SELECT 1, rk, so, ord, title, body, url, source FROM p4 ORDER BY rk, so LIMIT 12)),
  c1 AS (SELECT row_number() OVER (ORDER BY lane, rk, so, ord) - 1 AS i, * FROM c0)"""

_SPEECH = f"""
  e AS (SELECT *, min(t) OVER s AS b, coalesce(count(*) FILTER (WHERE kind = 'end') OVER (PARTITION BY session_id ORDER BY t, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run
        FROM {values(X.SPEECH, 'session_id, t, ord, kind, final, interim, error')} WINDOW s AS (PARTITION BY session_id)),
  f AS (SELECT session_id, run, max(CASE WHEN kind = 'end' THEN 1 ELSE 0 END) AS ended, arg_max(coalesce(final, ''), ord) FILTER (WHERE kind = 'result') AS final FROM e GROUP BY ALL),
  g AS (SELECT session_id, run, coalesce(bool_or(ended = 1 AND trim(coalesce(final, '')) <> '') OVER (PARTITION BY session_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS carried FROM f),
  w AS (SELECT e.*, kind = 'result' AND (trim(coalesce(final, '') || coalesce(interim, '')) <> '' OR carried) AS spoken FROM e JOIN g USING (session_id, run)),
  x AS (SELECT *, lead(t) OVER (PARTITION BY session_id ORDER BY t, ord) AS nx FROM w WHERE spoken),
  d AS (
    SELECT session_id, t AS stop, 1 AS k, 'fatal' AS reason FROM w WHERE kind = 'error' AND error IN ('not-allowed', 'service-not-allowed', 'audio-capture')
    UNION ALL SELECT session_id, t, 2, 'stopped' FROM w WHERE kind = 'stop' UNION ALL SELECT DISTINCT session_id, b + 45, 3, 'longest' FROM w
    UNION ALL SELECT session_id, any_value(b) + 8, 4, 'no word' FROM w GROUP BY session_id HAVING coalesce(min(t) FILTER (WHERE spoken), 1e9) > any_value(b) + 8
    UNION ALL SELECT session_id, t + 3.5, 5, 'silence' FROM x WHERE coalesce(nx, 1e9) - t > 3.5 UNION ALL SELECT session_id, t, 6, 'restarts' FROM w WHERE kind = 'end' AND run > 60),
  z AS (SELECT session_id, min(stop) AS stop, arg_min(reason, stop * 10 + k) AS reason FROM d GROUP BY session_id),
  h AS (SELECT w.*, z.stop, z.reason FROM w JOIN z USING (session_id) WHERE t <= z.stop),
  r AS (SELECT session_id, run, any_value(b) AS b, any_value(stop) AS stop, any_value(reason) AS reason, bool_or(kind = 'end' AND t < stop) AS ended, arg_max(coalesce(final, ''), ord) FILTER (WHERE kind = 'result') AS final,
          arg_max(coalesce(interim, ''), ord) FILTER (WHERE kind = 'result') AS interim FROM h GROUP BY session_id, run)
  SELECT session_id, round(any_value(b), 3)::DOUBLE AS start, round(any_value(stop), 3)::DOUBLE AS stop, any_value(reason) AS reason, trim(string_agg(coalesce(final, '') || CASE WHEN ended THEN '' ELSE coalesce(interim, '') END, '' ORDER BY run)) AS transcript FROM r GROUP BY session_id"""

_CHATS = f"""
  a AS (SELECT *, NOT (status = 429 OR status >= 500) OR (status = 429 AND coalesce(ra, 0) > 300) OR attempt >= 3 AS ends, least(CASE WHEN coalesce(ra, 0) > 0 THEN ra * 1000 ELSE (attempt + 1) * 15000 END, 120000) AS wait FROM {values(X.CHAT, 'model, call_ord, attempt, status, ra, content')}),
  l AS (SELECT model, call_ord, min(attempt) FILTER (WHERE ends) AS last FROM a GROUP BY ALL),
  c AS (SELECT model, call_ord, max(content) FILTER (WHERE attempt = last AND status BETWEEN 200 AND 299) AS content, max(status) FILTER (WHERE attempt = last) AS status, count(*) FILTER (WHERE last IS NULL OR attempt <= last) AS tried,
          coalesce(sum(wait) FILTER (WHERE last IS NULL OR attempt < last), 0) AS waited_ms FROM a JOIN l USING (model, call_ord) GROUP BY ALL),
  b AS (SELECT *, coalesce(call_ord > min(call_ord) FILTER (WHERE status = 429) OVER (PARTITION BY model), false) AS skipped FROM c)
  SELECT model, call_ord, CASE WHEN NOT skipped THEN content END AS content, CASE WHEN NOT skipped THEN status END AS status, CASE WHEN skipped THEN 0 ELSE tried END::INT AS tried, CASE WHEN skipped THEN 0 ELSE waited_ms END::BIGINT AS waited_ms, skipped FROM b"""


def _request(prompt: rewriting.Prompt, size: int) -> str:
    text = lambda s, **kv: _replace_all(q(s), {f"{{{k}}}": v for k, v in kv.items()})
    return f"""SELECT article_id, batch_id::INT AS batch_id, n, {q(prompt.system)} AS system, {text(prompt.user, n='n')} || chr(10) || chr(10) || xs AS user FROM (
      SELECT article_id, unit_id // {size} AS batch_id, count(*) AS n, string_agg({text(prompt.item, k=f'(unit_id % {size} + 1)', formal='formal')}, chr(10) ORDER BY unit_id) AS xs FROM {values(X.UNITS, 'article_id, unit_id, formal')} GROUP BY ALL)"""


def _replace_all(x: str, by: dict[str, str]) -> str:
    for k, v in by.items():
        x = f"replace({x}, {q(k)}, {v}::VARCHAR)"
    return x


_GREEDY = """
  n AS (SELECT row_number() OVER (ORDER BY {order}) AS k, * FROM {rows} ORDER BY {order} LIMIT 12),
  f AS (
    SELECT 0::BIGINT AS k, []::BIGINT[] AS ords, []::VARCHAR[] AS ts, []::VARCHAR[] AS ds
    UNION ALL
    SELECT f.k + 1, CASE WHEN good THEN list_append(ords, {order}) ELSE ords END, CASE WHEN good THEN list_append(ts, t) ELSE ts END, CASE WHEN good THEN list_append(ds, d) ELSE ds END
    FROM (SELECT f.*, n.{order}, n.t, n.d, len(ords) < 4 AND NOT coalesce(list_contains(ts, n.t), false) AND NOT coalesce(list_contains(ds, n.d), false) AND n.n >= 80 AS good FROM f JOIN n ON n.k = f.k + 1) f)"""

_VOICES = """f AS (SELECT {scen}, who, min({ord}) AS fi FROM c GROUP BY ALL),
  k AS (SELECT {scen}, who, (dense_rank() OVER (PARTITION BY {scen} ORDER BY fi) - 1) % 3 AS k FROM f),
  v AS (SELECT c.*, """ + q(dialogue.VOICES) + """[k + 1] AS voice FROM c JOIN k USING ({scen}, who))"""

_AUDIO = "substr(sha1(text || '|' || voice), 1, 16) || '.mp3'"
_HAN_DOCS = f"(SELECT doc_id, {han("coalesce(text, '')")} AS t FROM documents)"
_HAN_TURNS = f"(SELECT conv_id || ':' || turn AS k, {han('text')} AS t FROM conversations WHERE text IS NOT NULL)"

ORACLE = {
    "char_measures": f"SELECT doc_id, {count('t', L)}::INT AS letters, {fraction('t', L)}::DOUBLE AS fraction, round({density('t')}, 6) AS density FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "han_measures": f"SELECT doc_id, {count('t', H)}::INT AS han, round({fraction('t', H)}, 6) AS fraction, round({density('t')}, 6) AS density, {studyable('t', H)} AS studyable, round({news_score("(' ' || t)")}, 4)::DOUBLE AS score FROM {_HAN_DOCS}",
    "han_texts": f"SELECT id, {count('t', H)}::INT AS han, round({fraction('t', H)}, 6)::DOUBLE AS fraction, {studyable('t', H)} AS studyable, regexp_matches(t, '[0-9]') AS digits, {sub('t', f'[^{chars.CJK}]')} AS only, regexp_matches(t, '[㐀-䶿一-鿿豈-﫿]') AS shown FROM {values(X.HAN_TEXTS, 'id, t')}",
    "studyable_filter": f"SELECT doc_id FROM documents WHERE {n_hits('text', '\\p{L}')} >= 200",
    "split_sentences": f"SELECT doc_id, (pos - 1)::INT AS pos, s[pos] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS pos FROM (SELECT doc_id, {sentences('text', L)} AS s FROM documents))",
    "han_sentences": f"SELECT doc_id, len(s)::INT AS n, md5({joined('s', '|')}) AS digest FROM (SELECT doc_id, {sentences('t', H)} AS s FROM {_HAN_DOCS})",
    "pack_units": _digest_units(_units_of("(SELECT conv_id || ':' || turn AS k, text AS t FROM conversations WHERE text IS NOT NULL)", "k", "t", L), "k"),
    "han_units": _digest_units(_units_of(_HAN_TURNS, "k", "t", H), "k"),
    "page_paragraphs": f"SELECT page_id, (i - 1)::INT AS pos, ps[i] AS paragraph FROM (SELECT page_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT page_id, {page_paragraphs('html')} AS ps FROM pages)) WHERE ps[i] <> ''",
    "article_bodies": f"SELECT page_id, {joined(prose('html', L), chr(10) * 2)} AS body FROM pages",
    "han_bodies": f"SELECT id, {joined(prose('html', H), chr(10) * 2)} AS body FROM {values(X.PAGES, 'id, html')}",
    "junk_filter": f"SELECT id, {junk('p')} AS junk FROM {values(X.JUNK_ROWS, 'id, p')}",
    "strip_junk": f"SELECT array_to_string(list_filter(regexp_split_to_array(b, '\\n{{2,}}'), lambda x: NOT {junk('x')}), chr(10) || chr(10)) AS body FROM (SELECT string_agg(p, chr(10) || chr(10) ORDER BY id) AS b FROM {values(X.JUNK_ROWS, 'id, p')})",
    "clean_titles": f"SELECT id, {trim(sub(trim(sub('t', f'{SP}+-{SP}+[^-]+$')), f'(?:{SP}*[|｜]{SP}*(?:{clean.NAV}){SP}*)+$'))} AS title FROM {values(X.TITLES, 'id, t')}",
    "feed_catalogue": f"SELECT * FROM {values([(i, u, s) for i, (u, s) in enumerate(feeds.FEEDS)], 'feed_ord, url, source')}",
    "rss_items": f"SELECT feed_ord, item_ord::INT AS item_ord, title, link, description, content, published FROM {_ITEMS}",
    "fetched_articles": f"SELECT feed_ord, item_ord::INT AS item_ord, title, body, link AS url, published, source FROM {_PRIMARY}",
    "custom_feed": f"SELECT feed_ord, item_ord::INT AS item_ord, title, body FROM (SELECT *, row_number() OVER (PARTITION BY feed_ord ORDER BY item_ord) AS r FROM (SELECT *, CASE WHEN {count('content', H)} > {count('description', H)} THEN content ELSE description END AS body FROM {_ITEMS}) WHERE {studyable('body', H)}) WHERE r <= 4",
    "resolved_links": f"SELECT link, CASE WHEN regexp_extract(link, '/articles/([^?/]+)', 1) <> '' AND regexp_extract(splash, 'data-n-a-ts=\"([^\"]+)\"', 1) <> '' AND regexp_extract(splash, 'data-n-a-sg=\"([^\"]+)\"', 1) <> '' THEN nullif(regexp_extract(replace(reply, '\\/', '/'), 'garturlres\\\\?\",\\\\?\"(https?:[^\"\\\\]+)', 1), '') END AS url FROM {values(X.WRAPPED, 'link, splash, reply')}",
    "search_articles": f"""
        WITH RECURSIVE i AS (SELECT *, {trim(sub(trim(sub('title', f'{SP}+-{SP}+[^-]+$')), f'(?:{SP}*[|｜]{SP}*(?:{clean.NAV}){SP}*)+$'))} AS ct FROM {items(values([(0, 's', X.SEARCH_XML)], 'feed_ord, source, xml'))} WHERE item_ord < 12),
        l AS (SELECT * FROM {values([(X.WRAPPED[0][0], 'https://publisher.example/story1'), (X.WRAPPED[1][0], 'https://other.example/story2')], 'link, url')}),
        r AS (SELECT item_ord, ct AS title, substr(ct, 1, 12) AS t, {host('l.url')} AS d, l.url, published, coalesce({joined(prose('html', H), chr(10) * 2)}, '') AS body FROM i JOIN l USING (link) LEFT JOIN {values(X.SEARCH_PAGES, 'url, html')} ON v.url = l.url WHERE ct <> ''),
        m AS (SELECT *, {count('body', H)} AS n FROM r), {_GREEDY.format(order='item_ord', rows='m')}
        SELECT item_ord::INT AS ord, title, body, url, published FROM m WHERE list_contains((SELECT ords FROM f ORDER BY k DESC LIMIT 1), item_ord)""",
    "full_bodies": f"SELECT id, CASE WHEN {count('page', H)} > {count('body', H)} THEN page ELSE body END AS body FROM (SELECT id, body, coalesce({container_body('html')}, '') AS page FROM {values([(1, 'http://a', '短。'), (2, 'http://b', '沒有頁面。'), (3, 'http://a', '很長的文字' * 30)], 'id, url, body')} LEFT JOIN {values([('http://a', X.STORY)], 'url, html').replace('AS v', 'AS pg')} USING (url))",
    "news_scores": f"SELECT id, round({news_score('x')}, 4)::DOUBLE AS score FROM (SELECT id, t || ' ' AS x FROM {values(X.HAN_TEXTS, 'id, t')})",
    "dedup_first_wins": "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1",
    "dedup_greedy": f"WITH RECURSIVE r AS (SELECT page_id, substr(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), 1, 12) AS t, {host('url')} AS d, length(html) AS n FROM pages), {_GREEDY.format(order='page_id', rows='r')} SELECT page_id, t AS prefix, d AS host FROM r WHERE list_contains((SELECT ords FROM f ORDER BY k DESC LIMIT 1), page_id)",
    "balanced_pick": "SELECT doc_id, source, rk::INT AS rk FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rk, min(doc_id) OVER (PARTITION BY source) AS so FROM documents) ORDER BY rk, so LIMIT 12",
    "first_per_source": "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 3",
    "relaxed_pool": "SELECT doc_id FROM documents WHERE n_chars >= CASE WHEN (SELECT count(*) FROM documents WHERE n_chars >= 8000) >= 200 THEN 8000 ELSE 4000 END",
    "guaranteed_lanes": "SELECT doc_id, 0 AS lane FROM (SELECT doc_id FROM documents WHERE lang = 'de' ORDER BY doc_id LIMIT 4) UNION ALL SELECT doc_id, 1 FROM (SELECT doc_id FROM documents WHERE lang <> 'de' ORDER BY doc_id LIMIT 8)",
    "new_articles": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "best_voice": f"SELECT id, score FROM (SELECT id, CASE WHEN name LIKE '%sinji%' THEN 6 WHEN lang = 'zh-hk' OR lang LIKE 'yue%' THEN 5 WHEN regexp_matches(name, 'cantonese|粵|aasing|aacantonese') THEN 5 WHEN lang LIKE '%hk%' THEN 4 WHEN lang LIKE 'zh%' THEN 1 ELSE -1 END AS score FROM (SELECT id, replace(lower(coalesce(lang, '')), '_', '-') AS lang, lower(coalesce(name, '')) AS name FROM {values(X.VOICES, 'id, lang, name')})) WHERE score >= 0 ORDER BY score DESC, id LIMIT 1",
    "voice_scores": f"SELECT id, CASE WHEN name LIKE '%sinji%' THEN 6 WHEN lang = 'zh-hk' OR lang LIKE 'yue%' THEN 5 WHEN regexp_matches(name, 'cantonese|粵|aasing|aacantonese') THEN 5 WHEN lang LIKE '%hk%' THEN 4 WHEN lang LIKE 'zh%' THEN 1 ELSE -1 END AS score FROM (SELECT id, replace(lower(coalesce(lang, '')), '_', '-') AS lang, lower(coalesce(name, '')) AS name FROM {values(X.VOICES, 'id, lang, name')})",
    "rules_rewrite": f"SELECT id, {joined(f'list_transform({rule_segments('t')}, lambda z: z.f)', '|')} AS formal, {joined(f'list_transform({rule_segments('t')}, lambda z: z.c)', '|')} AS colloquial FROM {values(X.HAN_TEXTS, 'id, t')}",
    "loaded_rules": loaded_rules("t", values(X.HAN_TEXTS, "id, t")),
    "han_rewrite": f"SELECT k, {spoken(rule_pairs('t'))} AS colloquial FROM {_HAN_TURNS}",
    "cardinal_reading": f"SELECT n, {cardinal('n')} AS reading FROM (SELECT * FROM {values([(n,) for n in X.NUMBERS], 'n')} UNION ALL SELECT (o_orderkey * 7919 * (o_orderkey % 100003))::VARCHAR FROM orders)",
    "spell_numbers": f"SELECT id, {spell('t', 'a')} AS spelled FROM (SELECT id, {normalize_digits('t')} AS t, a FROM {values(X.SPELL, 'id, t, a')})",
    "spell_orders": f"SELECT o_orderkey, t, {spell('t')} AS spelled FROM (SELECT o_orderkey, {order_text().replace('AS STRING', 'AS VARCHAR')} AS t FROM orders)",
    "spell_pairs": f"SELECT id, {joined('list_transform(ps, lambda z: z.f)', '|')} AS formal, {joined('list_transform(ps, lambda z: z.c)', '|')} AS spoken FROM (SELECT id, {spell_pairs(rule_segments('t'))} AS ps FROM {values(X.SPELL, 'id, t, a')})",
    "number_runs": f"SELECT id, (i - 1)::INT AS pos, xs[i] AS run, regexp_matches(xs[i], '^[0-9]') AS num FROM (SELECT id, xs, unnest(range(1, len(xs) + 1)) AS i FROM (SELECT id, {hits('t', NUM + '|[^0-9]+')} AS xs FROM {values(X.SPELL, 'id, t, a')}))",
    "digits_reading": f"SELECT p_partkey, {digits('p_partkey::VARCHAR')} AS reading FROM part",
    "align_invariants": f"SELECT id, t AS formal, {spoken(rule_pairs('t'))} AS colloquial, t <> '' AS ok FROM {values(X.HAN_TEXTS, 'id, t')}",
    "grade_attempts": _grade(),
    "sentence_quality": _rules(_QUALITY, "id", _sentence_checks("f", "c", "j", "p")).replace("AS place", "AS id"),
    "quality_counts": f"SELECT rule, count(place) AS failures FROM (SELECT unnest({q(list(_sentence_checks('f', 'c', 'j', 'p')))}) AS rule) LEFT JOIN ({_rules(_QUALITY, 'id', _sentence_checks('f', 'c', 'j', 'p'))}) USING (rule) GROUP BY rule",
    "dialogue_voices": f"WITH c AS (SELECT *, coalesce(nullif(role, ''), '?') AS who FROM conversations WHERE coalesce(text, '') <> ''), {_VOICES.format(scen='conv_id', ord='turn')} SELECT conv_id, turn, role, voice, {_AUDIO} AS audio FROM v",
    "news_audio": f"SELECT article_id, sentence_id, text, voice, {_AUDIO} AS audio FROM ({_TIERS} SELECT article_id, unit_id::INT AS sentence_id, coalesce(nullif(said, ''), formal) AS text, '{dialogue.NEWS_VOICE}' AS voice FROM s1)",
    "dialogue_audio": f"WITH c AS (SELECT cat || '/' || sid AS article_id, i::INT AS sentence_id, x.colloquial AS text, coalesce(nullif(x.speaker, ''), '?') AS who FROM {_LINES.replace("coalesce(c.id, '?')", "c.id")} WHERE coalesce(x.colloquial, '') <> ''), {_VOICES.format(scen='article_id', ord='sentence_id')} SELECT article_id, sentence_id, text, voice, {_AUDIO} AS audio FROM v",
    "audio_injected": f"SELECT article_id, sentence_id, CASE WHEN sentence_id % 2 = 0 THEN substr(sha1(text || '|{dialogue.NEWS_VOICE}'), 1, 16) || '.mp3' END AS audio FROM ({_TIERS} SELECT article_id, unit_id::INT AS sentence_id, coalesce(nullif(said, ''), formal) AS text FROM s1)",
    "curriculum_checks": _rules(_SRC, "coalesce(c.id, '?')", {"category id and titles": f"coalesce(c.id, '') <> '' AND {_TITLED('c.title')}", "scenarios": "len(c.scenarios) >= 12"})
    + " UNION ALL " + _rules(_SCEN, "cat || '/' || coalesce(s.id, '?')", {"scenario id, title and lines": "coalesce(s.id, '') <> '' AND s.title IS NOT NULL AND len(s.lines) > 0"})
    + " UNION ALL " + _rules(_LINES, "cat || '/' || sid || '#' || i", {"formal": "coalesce(x.formal, '') <> ''", "colloquial": "coalesce(x.colloquial, '') <> ''", "written-layer": f"NOT regexp_matches(coalesce(x.formal, ''), '[{quality.SPOKEN_ONLY}]')", "digits": "NOT regexp_matches(concat(x.formal, x.colloquial), '[0-9]')"}),
    "curriculum_built": f"SELECT cat, s.id AS scenario, CASE WHEN coalesce(s.emoji, '') = '' THEN '💬' ELSE s.emoji END AS emoji, CASE WHEN coalesce(s.level, 0) = 0 THEN 1 ELSE s.level END AS level, i::INT - 1 AS line, s.lines[i].formal AS formal, s.lines[i].colloquial AS colloquial, coalesce(s.lines[i].en, '') AS en, {_JYUTPING.replace('said', 's.lines[i].colloquial')} AS jyutping FROM (SELECT *, unnest(range(1, len(s.lines) + 1)) AS i FROM {_SCEN})",
    "conversation_checks": _rules(_SRC, "coalesce(c.id, '?')", {"category id and titles": f"coalesce(c.id, '') <> '' AND {_TITLED('c.title')}", "scenarios": "len(c.scenarios) >= 12"})
    + " UNION ALL " + _rules(f"(SELECT * FROM {_SCEN} WHERE cat = 'food')", "cat || '/' || s.id", {"scenario id and titles": _TITLED("s.title"), "lines": "len(s.lines) > 0"})
    + " UNION ALL " + _rules(f"(SELECT cat, sid, i, x.formal AS f, x.colloquial AS c, x.speaker AS sp, list_transform(regexp_extract_all(x.colloquial, '(?s).'), lambda ch: coalesce(MAP {{{', '.join(f'{q(k)}: {q(v)}' for k, v in X.SPOKEN_READINGS.items())}}}[ch], '')) AS j FROM {_LINES} WHERE cat = 'food')", "cat || '/' || sid || '#' || i", {k: v for k, v in _sentence_checks("f", "c", "j", None).items()} | {"speaker": "coalesce(sp, '') <> ''"}),
    "scenario_articles": f"SELECT s.id AS id, coalesce(s.title.en, s.id) AS title, CASE WHEN coalesce(cat_title.en, '') <> '' THEN 'Talk · ' || cat_title.en ELSE 'Talk' END AS source, len(s.lines)::INT AS lines FROM {_SCEN}",
    "curriculum_summary": f"SELECT (SELECT count(*) FROM {_SRC})::INT AS categories, (SELECT count(*) FROM {_SCEN})::INT AS scenarios, (SELECT count(*) FROM {_LINES})::INT AS lines",
    "curriculum_files": f"SELECT count(DISTINCT c.id)::INT AS categories, count(*)::INT AS scenarios, sum(len(s.lines))::INT AS lines, true AS written FROM (SELECT c, unnest(c.scenarios) AS s FROM {_SRC.replace(q(json.dumps(X.CURRICULUM, ensure_ascii=False)), q(json.dumps(X.GOOD_SOURCE, ensure_ascii=False)))})",
    "speaker_names": f"SELECT id, CASE WHEN sp LIKE '{{%' THEN coalesce(json_extract_string(sp, '$.hans'), json_extract_string(sp, '$.hant'), json_extract_string(sp, '$.en')) ELSE sp END AS name FROM {values(X.SPEAKERS, 'id, sp')}",
    "labels": f"SELECT k, replace(replace(coalesce(max(text) FILTER (WHERE lang = 'hant'), max(text) FILTER (WHERE lang = 'en'), k), '{{0}}', '3'), '{{1}}', '9') AS label FROM (SELECT unnest(['lines', 'sentenceOf', 'only', 'none']) AS k) LEFT JOIN {values(X.LABELS, 'key, lang, text')} ON key = k GROUP BY k",
    "level_names": "SELECT l::INT AS level, CASE l WHEN 1 THEN '入門' WHEN 2 THEN '進階' WHEN 3 THEN '高級' ELSE '' END AS name FROM (SELECT unnest(range(0, 5)) AS l)",
    "shown_in_script": f"SELECT id, translate(t, {q(X.SCRIPT[0])}, {q(X.SCRIPT[1])}) AS shown FROM {values(X.HAN_TEXTS, 'id, t')}",
    "tier_fallback": "SELECT id, coalesce(t1, CASE WHEN t2 = f THEN r ELSE t2 END, r) AS text, CASE WHEN t1 IS NOT NULL THEN 'tier1' WHEN t2 IS NOT NULL THEN 'tier2' ELSE 'rules' END AS method FROM (VALUES (1, 'a', 'A', NULL, 'r'), (2, 'a', NULL, 'a', 'r'), (3, 'a', NULL, 'B', 'r'), (4, 'a', NULL, NULL, 'r')) AS v(id, f, t1, t2, r)",
    "json_replies": f"SELECT id, {_reply('t', 'false')} IS NOT NULL AS parsed, array_to_string(from_json(json_extract({_reply('t', 'false')}, '$.sentences'), '[\"VARCHAR\"]'), '|') AS sentences FROM {values(X.REPLIES, 'id, t')}",
    "model_requests": _request(rewriting.PLAIN_REWRITE, 2),
    "tier1_rewrites": f"WITH {_tier1()} SELECT article_id, unit_id::INT AS unit_id, colloquial, array_to_string(list_transform(pairs, lambda z: z.f || '>' || z.c), '|') AS pairs, verified, repaired FROM t1",
    "tier2_rewrites": f"WITH {_tier2()} SELECT article_id, unit_id::INT AS unit_id, colloquial FROM t2",
    "chat_outcomes": f"WITH {_CHATS}",
    "daily_articles": f"WITH {_CHOSEN} SELECT 'a' || i AS article_id, title, md5(body) AS body, source FROM c1 WHERE i < 12",
    "lesson_sentences": f"{_TIERS} SELECT article_id, unit_id::INT AS unit_id, formal, said AS colloquial, {_JYUTPING} AS jyutping, method FROM s1",
    "lesson_articles": f"{_TIERS} SELECT article_id AS id, bool_or(formal <> said) AS converted, max(method) AS method, CASE WHEN bool_or(coalesce(v, false)) THEN true END AS verified, CASE WHEN bool_or(coalesce(v, false)) THEN count(*) FILTER (WHERE r) END::INT AS repaired, count(*)::INT AS sentences, bool_or(formal <> said) = false AND max(method) <> 'rules' AS unavailable FROM s1 GROUP BY article_id",
    "lesson_files": f"{_TIERS} SELECT 'llm+verify' AS method, {q(lessons.NOTES['llm+verify'])} AS note, count(DISTINCT article_id) AS articles, count(*) AS sentences, coalesce(count(*) FILTER (WHERE r), 0) AS repaired FROM s1",
    "lesson_checks": f"{_TIERS}, j AS MATERIALIZED (SELECT *, list_transform(regexp_extract_all(said, '(?s).'), lambda ch: coalesce(MAP {{{', '.join(f'{q(k)}: {q(v)}' for k, v in X.SPOKEN_READINGS.items())}}}[ch], '')) AS jy FROM s1) " + _rules("j", "'daily ' || article_id || '#' || unit_id", _sentence_checks("formal", "said", "jy", None)),
    "lesson_fallback": "SELECT unnest(['absent', 'empty', 'broken', 'full']) AS daily, unnest(['sample', 'sample', 'sample', 'daily']) AS source",
    "paragraph_groups": f"SELECT k, paragraph_id, count(*)::INT AS lines, md5(string_agg(formal, '|' ORDER BY unit_id)) AS digest FROM {_units_of(_HAN_TURNS, 'k', 't', H)} GROUP BY ALL",
    "reading_dictionary": f"SELECT ch, array_to_string(list_distinct_in_order, ' ') AS readings FROM (SELECT ch, list_filter(list(s ORDER BY ord), lambda z, i: list_position(list(s ORDER BY ord), z) = i) AS list_distinct_in_order FROM (SELECT ch, ord, regexp_replace(syllable, '[0-9]+$', '') AS s FROM {values(X.READING_ROWS, 'ch, ord, syllable')} WHERE unicode(ch) BETWEEN {0x3400} AND {0x4DBF} OR unicode(ch) BETWEEN {0x4E00} AND {0x9FFF}) WHERE s <> '' GROUP BY ch)",
    "speech_sessions": """
        WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS stop, count(*) AS n FROM k GROUP BY user_id, k""",
    "speech_listen": f"WITH {_SPEECH}",
    "hostnames": "SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS host FROM pages",
    "lesson_units": f"""
        SELECT k, paragraph_id, unit_id, formal, chars, formal AS colloquial FROM (
          SELECT 'page-' || page_id AS k, (i - 1)::INT AS paragraph_id, unnest(range(1, len(us) + 1))::INT - 1 AS unit_id, unnest(us).text AS formal, unnest(us).chars AS chars
          FROM (SELECT page_id, i, {pack('xs[i]', L)} AS us FROM (SELECT page_id, xs, unnest(range(1, len(xs) + 1)) AS i FROM (SELECT page_id, {prose('html', L)} AS xs FROM pages))))
        UNION ALL
        SELECT k, paragraph_id, unit_id, formal, chars, {spoken(spell_pairs(rule_segments('formal')))} AS colloquial FROM {_units_of(f"(SELECT 'han-' || id AS k, t FROM {values(X.HAN_TEXTS, 'id, t')})", 'k', 't', H)}""",
}
