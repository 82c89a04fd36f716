"""DuckDB SQL of the queries that SQL can express; written from their contracts, window by window."""

from __future__ import annotations

from millrace.llm import backoff, decontaminate, quality, urls

_AZ = f"'{decontaminate.UPPER}', '{decontaminate.LOWER}'"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_WORDS} AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(ws), {decontaminate.WINDOW}) AS n, ws[i : i + least(len(ws), {decontaminate.WINDOW}) - 1] AS w
  FROM (SELECT *, unnest(range(1, greatest(len(ws) - {decontaminate.WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
pos AS (SELECT rid, n, i, ws[i : i + n - 1] AS w FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n)),
hit AS (SELECT rid, i, pos.n AS n, item_id FROM pos JOIN win ON pos.n = win.n AND pos.w = win.w),
hw AS (SELECT rid, count(DISTINCT i + k) AS n_hit FROM (SELECT rid, i, unnest(range(0, n)) AS k FROM hit) GROUP BY rid),
hi AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit > 0 AND 20 * n_hit >= len(ws), false) AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)"""

SUBSTRINGS = r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT rid, doc_id, i, ws[i : i + 19] AS s FROM (SELECT *, unnest(range(1, len(ws) - 18)) AS i FROM d)),
o AS (SELECT rid, i, rank() OVER (PARTITION BY s ORDER BY doc_id NULLS LAST, i) AS place FROM win),
gone AS (SELECT DISTINCT rid, i + k AS i FROM (SELECT rid, i, unnest(range(0, 20)) AS k FROM o WHERE place > 1)),
w AS (SELECT rid, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d),
kept AS (SELECT rid, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS text FROM w ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)"""


def url_templates(rules: list[urls.Rule]) -> str:
    fits = [(r, f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))") for r in sorted(rules, key=lambda r: (-len(r.text), r.text))]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r.text}'" for r, f in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{r.verdict}'" for r, f in fits) + " END"
    own = lambda x: x.replace("host ", "p.host ").replace("(host,", "(p.host,")
    lists, tops = [], []
    for k in range(urls.DEPTH + 1):  # down: l0 has empty templates, l1 those of one segment, ...
        seg = f"segs[{k + 1}]"
        lists.append(f"""k{k} AS (SELECT host, template, {seg} AS seg, sum(labelled) AS labelled FROM l{k} WHERE len(segs) > {k} AND NOT starts_with({seg}, '*') GROUP BY ALL),
o{k} AS (SELECT host, template, seg FROM k{k} QUALIFY count(*) OVER (PARTITION BY host, template) > {urls.FANOUT} AND labelled < {urls.EVIDENCE}),
l{k + 1} AS (SELECT l.host, segs, n, labelled, bad, l.template || CASE WHEN len(segs) > {k} THEN '/' || CASE WHEN o.seg IS NULL THEN {seg} ELSE '*' END ELSE '' END AS template FROM l{k} l LEFT JOIN o{k} o ON l.host = o.host AND l.template = o.template AND {seg} = o.seg)""")
    for k in range(urls.DEPTH + 1, 0, -1):  # up: b7 has the templates themselves, b6 those of level 7 merged, ...
        tops.append(f"""g{k} AS (SELECT host, branch, regexp_replace(branch, '/[^/]*\\z', '') AS parent, sum(labelled) AS l, sum(bad) AS b FROM b{k} WHERE depth = {k} GROUP BY ALL),
h{k} AS (SELECT *, sum(l) OVER (PARTITION BY host, parent) AS pl, sum(b) OVER (PARTITION BY host, parent) AS pb FROM g{k}),
m{k} AS (SELECT host, branch, parent FROM h{k} WHERE pow(CAST(b * pl - pb * l AS DOUBLE), 2) <= {urls.Z * urls.Z} * CAST(pb * (pl - pb) AS DOUBLE) * CAST(l AS DOUBLE)),
b{k - 1} AS (SELECT b.host, template, labelled, bad, coalesce(parent, b.branch) AS branch, CASE WHEN parent IS NULL THEN depth ELSE {k - 1} END AS depth FROM b{k} b LEFT JOIN m{k} m ON b.host = m.host AND b.branch = m.branch)""")
    return rf"""WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{urls.PARTS}', 1), {_AZ}) AS host, regexp_extract(coalesce(url, ''), '{urls.PARTS}', 2) AS path FROM pages),
s AS (SELECT *, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda s: CASE WHEN regexp_matches(s, '[0-9]') THEN '*' || regexp_extract(s, '(\.[A-Za-z]+)?\z', 1) ELSE s END) AS found FROM u),
lab AS (SELECT doc_id AS page_id, max(quality = 0 OR toxic = 1) AS bad FROM labels GROUP BY doc_id),
p AS (SELECT s.page_id, host, path, bad, CASE WHEN len(found) > {urls.DEPTH} THEN list_append(found[1:{urls.DEPTH}], '**') ELSE found END AS segs FROM s LEFT JOIN lab USING (page_id)),
l0 AS (SELECT host, segs, count(*) AS n, count(bad) AS labelled, count(*) FILTER (WHERE bad) AS bad, '' AS template FROM p GROUP BY host, segs),
{", ".join(lists)},
b{urls.DEPTH + 1} AS (SELECT host, template, sum(labelled) AS labelled, sum(bad) AS bad, template AS branch, length(template) - length(replace(template, '/', '')) AS depth FROM l{urls.DEPTH + 1} GROUP BY host, template),
{", ".join(tops)},
w AS (SELECT host, branch, sum(labelled) AS labelled, sum(bad) AS bad FROM b0 GROUP BY host, branch),
x AS (SELECT *, sum(labelled) OVER (PARTITION BY host) AS hl, sum(bad) OVER (PARTITION BY host) AS hb, CAST(sum(bad) OVER () + 1 AS DOUBLE) / (sum(labelled) OVER () + 2) AS q FROM w),
y AS (SELECT host, branch, q, labelled, (bad + {urls.PRIOR} * ((hb - bad + {urls.PRIOR} * q) / (hl - labelled + {urls.PRIOR}))) / (labelled + {urls.PRIOR}) AS share FROM x),
v AS (SELECT t.host, t.segs, y.labelled > 0 AND share >= {urls.RATIO} * q / (1 + ({urls.RATIO} - 1) * q) AS reject FROM l{urls.DEPTH + 1} t JOIN b0 ON t.host = b0.host AND t.template = b0.template JOIN y ON b0.host = y.host AND b0.branch = y.branch)
SELECT page_id, p.host, path, {own(rule)} AS rule, coalesce({own(verdict)}, CASE WHEN reject THEN 'block' ELSE 'allow' END) AS verdict
FROM p JOIN v ON p.host = v.host AND p.segs = v.segs"""


ORACLES = {
    "op2_winnowing_decontamination": DECONTAMINATION,
    "op4_quality_rules": quality.ORACLE,
    "op6_stupid_backoff": backoff.ORACLE,
    "op7_substring_dedup": SUBSTRINGS,
}
