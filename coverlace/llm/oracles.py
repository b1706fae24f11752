"""SQL that equals corpus queries, where SQL can express them."""

from __future__ import annotations

from coverlace.llm.urls import DAMPING, ROUNDS, Rule


def _rank(name: str, edges: str, seeds: str) -> str:
    """Common table expressions of ``ROUNDS`` steps of personalised PageRank; the last is ``name``_r."""
    parts = [f"{name}_out AS (SELECT src, sum(n) AS total FROM {edges} GROUP BY 1)", f"{name}_steps AS MATERIALIZED (SELECT e.src, e.dst, e.n::DOUBLE / o.total AS share FROM {edges} e JOIN {name}_out o USING (src))", f"{name}_0 AS (SELECT host, mass AS score FROM {seeds})"]
    for k in range(1, ROUNDS + 1):
        parts.append(f"{name}_m{k} AS MATERIALIZED (SELECT s.dst AS host, {DAMPING}::DOUBLE * sum(r.score * s.share) AS score FROM {name}_steps s JOIN {name}_{k - 1} r ON r.host = s.src GROUP BY 1)")
        parts.append(f"{name}_{k} AS MATERIALIZED (SELECT host, sum(score) AS score FROM (SELECT host, score FROM {name}_m{k} UNION ALL SELECT host, mass * (1 - (SELECT coalesce(sum(score), 0) FROM {name}_m{k})) FROM {seeds}) GROUP BY 1)")
    parts.append(f"{name}_r AS (SELECT host, score FROM {name}_{ROUNDS})")
    return ",\n".join(parts)


def url_filters(rules: list[Rule]) -> str:
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN" for _, h, p in order]
    rule = "CASE " + " ".join(f"{f} '{h}{p}'" for f, (_, h, p) in zip(fits, order)) + " END"
    ruled = "CASE " + " ".join(f"{f} '{v}'" for f, (v, _, _) in zip(fits, order)) + " END"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH cut AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (SELECT page_id, html, {lower.format("regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
judged AS MATERIALIZED (SELECT *, {rule} AS rule, {ruled} AS ruled FROM parsed),
found AS (SELECT host AS src, unnest(list_distinct(regexp_extract_all(html, '(?i)\\bhref\\s*=\\s*["'']?\\s*((?:https?:)?//[^"''\\s>]+)', 1))) AS target FROM judged WHERE host <> ''),
targets AS (SELECT src, {lower.format("regexp_extract(target, '//([^/?#]*)', 1)")} AS dst FROM found),
edges AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM targets WHERE dst <> '' AND src <> dst GROUP BY 1, 2),
reversed AS (SELECT dst AS src, src AS dst, n FROM edges),
hosts AS MATERIALIZED (SELECT host, sum((ruled IS NOT DISTINCT FROM 'allow')::INT)::DOUBLE AS good, sum((ruled IS NOT DISTINCT FROM 'block')::INT)::DOUBLE AS bad FROM judged WHERE host <> '' GROUP BY 1),
good_seeds AS (SELECT host, good / (SELECT sum(good) FROM hosts) AS mass FROM hosts WHERE good > 0),
bad_seeds AS (SELECT host, bad / (SELECT sum(bad) FROM hosts) AS mass FROM hosts WHERE bad > 0),
{_rank("trust", "edges", "good_seeds")},
{_rank("distrust", "reversed", "bad_seeds")}
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN coalesce(d.score, 0) > coalesce(t.score, 0) THEN 'block' ELSE 'allow' END) AS verdict, round(coalesce(t.score, 0), 9) AS trust, round(coalesce(d.score, 0), 9) AS distrust
FROM judged LEFT JOIN trust_r t USING (host) LEFT JOIN distrust_r d USING (host)"""
