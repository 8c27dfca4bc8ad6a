"""SQL twins of the pair scores and the edges: fingerprints, sketches, candidates, features and tiers as DuckDB SQL."""

from __future__ import annotations

from typing import Any

from windrow.functions import text as T


def _words(x: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({x}, ''), '[a-zA-Z0-9_]+'), lambda z: lower(z))"


def _jaccard(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) + len({b}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END)"


def _overlap(a: str, b: str) -> str:
    return f"(CASE WHEN least(len({a}), len({b})) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / least(len(list_distinct({a})), len(list_distinct({b}))) END)"


def _h(x: str, digits: int = 15) -> str:
    return f"CAST('0x' || substr(md5({x}), 1, {digits}) AS BIGINT)"


def fingerprints(filtered: str, cfg: dict[str, Any]) -> str:
    """Views fp (one row an active entity) and vec (id, part, idx, v, norm)."""
    s, dims = cfg["similarity"], cfg["embedding"]["dims"]
    stop = ", ".join(f"'{w}'" for w in T.STOP_TITLE)
    n = s["minhash_permutations"]
    minima = ", ".join("coalesce(min((h * {} + {}) % {}), 0)".format(*T.permutation(i), T.MERSENNE) for i in range(n))
    bits = " + ".join(f"CASE WHEN sum(CASE WHEN (h >> {i}) & 1 = 1 THEN 1 ELSE -1 END) >= 0 THEN {1 << i} ELSE 0 END" for i in range(60))
    head = "array_to_string(({})[1:64], ' ')"
    return filtered + f""", act AS (SELECT *, coalesce(title, '') AS ti, coalesce(body, '') AS bo FROM f WHERE filter_state = 'pass'),
b0 AS (SELECT id, kind, ci_status, approvals, priority_weight, changed_files, patch_ids, additions, deletions, list_filter(list_distinct({_words("ti")}), lambda z: length(z) >= 4 AND z NOT IN ({stop})) AS salient,
  {_words("ti || chr(10) || CASE WHEN kind = 'issue' THEN array_to_string(content, chr(10)) ELSE bo END")} AS w,
  list_sort(list_distinct(list_concat(linked_issues, CASE WHEN kind = 'issue' THEN [CAST(number AS VARCHAR)] ELSE []::VARCHAR[] END))) AS hard, soft_linked_issues AS soft,
  list_transform(hunks, lambda u: sha1(u.p || '|' || u.c || '|' || {head.format(_words("u.a"))} || '|' || {head.format(_words("u.r"))})) AS sigs,
  list_sort(list_distinct(list_transform(changed_files, lambda u: array_to_string((string_split(u, '/'))[1:2], '/') || '/*'))) AS modules, ti || chr(10) || bo AS txt,
  CASE WHEN len(changed_files) > 0 THEN 'files:' || array_to_string(changed_files, ' ') ELSE '' END || chr(10)
    || CASE WHEN len(hunks) > 0 THEN 'hunks:' || array_to_string(list_transform(hunks, lambda u: u.p || ' ' || u.c || ' ' || u.a || ' ' || u.r), ' ') ELSE '' END AS dif FROM act),
b1 AS (SELECT *, list_filter(list_transform(list_concat(list_concat(w, hard), list_concat(soft, sigs)), lambda z: lower(z)), lambda z: z <> '') AS m FROM b0),
ew AS (SELECT id, 't' AS part, unnest(regexp_extract_all(lower(txt), '[a-z0-9_]+')) AS x FROM b0 UNION ALL SELECT id, 'd', unnest(regexp_extract_all(lower(dif), '[a-z0-9_]+')) FROM b0),
ev AS (SELECT id, part, CAST('0x' || substr(sha256(x), 1, 8) AS BIGINT) % {dims} AS idx, CAST(sum(CASE WHEN CAST('0x' || right(sha256(x), 1) AS BIGINT) % 2 = 1 THEN -1 ELSE 1 END) AS DOUBLE) AS v FROM ew GROUP BY 1, 2, 3),
vec AS (SELECT id, part, idx, v, sqrt(sum(v * v) OVER (PARTITION BY id, part)) AS norm FROM ev WHERE v <> 0),
pr AS (SELECT id, m FROM b1 WHERE kind = 'pr'),
sh AS (SELECT id, unnest(CASE WHEN len(m) = 0 THEN []::VARCHAR[] WHEN len(m) < 3 THEN [array_to_string(m, ' ')]
  ELSE list_distinct(list_transform(range(1, len(m) - 1), lambda i: m[i] || ' ' || m[i + 1] || ' ' || m[i + 2])) END) AS x FROM pr),
mh AS (SELECT pr.id, [{minima}] AS sig FROM pr LEFT JOIN (SELECT id, {_h("x", 7)} AS h FROM sh) e ON e.id = pr.id GROUP BY pr.id),
si AS (SELECT id, CAST({bits} AS BIGINT) AS sim FROM (SELECT id, {_h("x")} AS h FROM (SELECT id, unnest(m) AS x FROM pr)) GROUP BY id),
g5 AS (SELECT id, len(m) AS n, i, {_h("array_to_string(m[i + 1 : i + 5], ' ')")} AS h FROM (SELECT id, m, unnest(range(0, greatest(len(m) - 4, 1))) AS i FROM pr WHERE len(m) > 0)),
w4 AS (SELECT id, i, greatest(n - 4, 1) AS c, min(h) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS h FROM g5),
wi AS (SELECT id, list(DISTINCT h) AS win FROM w4 WHERE i >= 3 OR (c < 4 AND i = c - 1) GROUP BY id),
fp AS (SELECT b1.*, coalesce(mh.sig, []) AS sig, coalesce(si.sim, 0) AS sim, b1.kind = 'pr' AS sketched, coalesce(wi.win, []) AS win
  FROM b1 LEFT JOIN mh ON mh.id = b1.id LEFT JOIN si ON si.id = b1.id LEFT JOIN wi ON wi.id = b1.id)
"""


def candidates(cfg: dict[str, Any], sketches: bool) -> str:
    """View met (entity_id, other, votes, mandatory): by hard links and files alone, all of
    them, or by every kind of key, of files and modules those that are not over their caps."""
    s = cfg["similarity"]
    rows = max(1, s["minhash_permutations"] // s["minhash_bands"])
    kinds = "SELECT id, 'hard' AS kind, unnest(hard) AS key FROM fp UNION ALL SELECT id, 'file', unnest(changed_files) FROM fp"
    if sketches:
        kinds += f""" UNION ALL SELECT id, 'soft', unnest(soft) FROM fp UNION ALL SELECT id, 'module', unnest(modules) FROM fp
  UNION ALL SELECT id, 'band', 'band:' || i || ':' || {_h(f"array_to_string(sig[i * {rows} + 1 : i * {rows} + {rows}], ',')")} FROM (SELECT id, sig, unnest(range(0, {s["minhash_bands"]})) AS i FROM fp WHERE sketched)
  UNION ALL SELECT id, 'chunk', i || ':' || ((sim >> (15 * i)) & 32767) FROM (SELECT id, sim, unnest(range(0, 4)) AS i FROM fp WHERE sketched)
  UNION ALL SELECT id, 'winnow', CAST(unnest(win) AS VARCHAR) FROM fp"""
    capped = f"""SELECT k0.* FROM k0 JOIN (SELECT kind, key FROM k0 GROUP BY 1, 2 HAVING count(*) <= CASE kind WHEN 'file' THEN {s["max_file_bucket"]} WHEN 'module' THEN {s["max_module_bucket"]} ELSE 9e18 END) z
  ON z.kind = k0.kind AND z.key = k0.key"""
    return f""", k0 AS (SELECT id, kind, key, count(*) AS times FROM ({kinds}) GROUP BY 1, 2, 3),
k1 AS ({capped if sketches else "SELECT * FROM k0"}),
met AS (SELECT a.id AS entity_id, b.id AS other, sum(a.times) AS votes, max((a.kind = 'hard')::INT) AS mandatory FROM k1 a JOIN k1 b ON a.kind = b.kind AND a.key = b.key AND a.id <> b.id GROUP BY 1, 2)
"""


def features(cfg: dict[str, Any], pairs: str) -> str:
    """View score over the pairs (entity_a, entity_b)."""
    s, w = cfg["similarity"], cfg["similarity"]["weights"]
    text, diff = s["semantic_text_share"], s["semantic_diff_share"]
    return f""", pq AS ({pairs}),
cs AS (SELECT q.entity_a, q.entity_b, x.part, sum(x.v * y.v) / any_value(x.norm * y.norm) AS c FROM pq q JOIN vec x ON x.id = q.entity_a JOIN vec y ON y.id = q.entity_b AND y.part = x.part AND y.idx = x.idx GROUP BY 1, 2, 3),
s0 AS (SELECT q.*, a.kind AS kind_a, b.kind AS kind_b, len(a.changed_files) AS files_a, len(b.changed_files) AS files_b,
  CASE WHEN len(list_intersect(a.patch_ids, b.patch_ids)) >= {s["lineage_min_shared"]} THEN greatest({_jaccard("a.patch_ids", "b.patch_ids")}, {_overlap("a.patch_ids", "b.patch_ids")})
    ELSE {_jaccard("a.patch_ids", "b.patch_ids")} END AS lineage,
  {_jaccard("a.sigs", "b.sigs")} AS hunk_overlap, {_jaccard("a.changed_files", "b.changed_files")} AS file_overlap, {_jaccard("a.salient", "b.salient")} AS title_salient,
  greatest({_jaccard("a.hard", "b.hard")}, {_overlap("a.hard", "b.hard")}) AS hard_link, {_jaccard("a.soft", "b.soft")} AS soft_link,
  coalesce(greatest(0.0::DOUBLE, (SELECT c FROM cs WHERE cs.entity_a = q.entity_a AND cs.entity_b = q.entity_b AND part = 't')), 0.0) AS semantic_text,
  coalesce(greatest(0.0::DOUBLE, (SELECT c FROM cs WHERE cs.entity_a = q.entity_a AND cs.entity_b = q.entity_b AND part = 'd')), 0.0) AS semantic_diff,
  CASE WHEN len(a.sig) = 0 OR len(a.sig) <> len(b.sig) THEN 0.0::DOUBLE ELSE len(list_filter(range(1, len(a.sig) + 1), lambda i: a.sig[i] = b.sig[i]))::DOUBLE / len(a.sig) END AS minhash,
  1 - bit_count(xor(a.sim, b.sim))::DOUBLE / 60 AS simhash, {_jaccard("a.win", "b.win")} AS winnow,
  least(1.0::DOUBLE, greatest(0.0::DOUBLE, log10(greatest(greatest(1, a.additions + a.deletions), greatest(1, b.additions + b.deletions))::DOUBLE
    / least(greatest(1, a.additions + a.deletions), greatest(1, b.additions + b.deletions))))) AS penalty
  FROM pq q JOIN fp a ON a.id = q.entity_a JOIN fp b ON b.id = q.entity_b),
s1 AS (SELECT *, 0.7::DOUBLE * hunk_overlap + 0.3::DOUBLE * file_overlap AS structure, ({text}::DOUBLE * semantic_text + {diff}::DOUBLE * semantic_diff) / {text + diff}::DOUBLE AS semantic FROM s0),
score AS (SELECT *, {w["lineage"]}::DOUBLE * lineage + {w["structure"]}::DOUBLE * structure + {w["semantic"]}::DOUBLE * semantic + {w["minhash"]}::DOUBLE * minhash
  + {w["simhash"]}::DOUBLE * simhash + {w["winnow"]}::DOUBLE * winnow - {w["size_penalty"]}::DOUBLE * penalty AS total FROM s1)
"""


def tiers(cfg: dict[str, Any]) -> str:
    """View edge: the scored pairs that have a tier."""
    s = cfg["similarity"]
    ps, weak, un, up, broad = s["pr_semantic"], s["weak"], s["unstructured"], s["unstructured_pr"], s["broad_pr"]
    prs, mixed, hard = "(kind_a = 'pr' AND kind_b = 'pr')", "(kind_a <> kind_b)", f"hard_link >= {s['hard_link_strong']}"
    return f""", edge AS (SELECT * FROM (SELECT *, CASE
  WHEN {prs} AND greatest(files_a, files_b) >= {broad["min_files"]} AND least(files_a, files_b) >= {broad["pair_min_files"]} AND hard_link <= 0 AND title_salient < {broad["title"]} AND semantic_text < {broad["semantic_text"]} THEN NULL
  WHEN {hard} AND (lineage > 0 OR structure >= {weak["structure"]}) THEN 'strong'
  WHEN {hard} AND {mixed} AND semantic >= {s["hard_link_semantic_issue_pr"]} THEN 'strong'
  WHEN {hard} AND NOT {mixed} AND semantic >= {s["hard_link_semantic_strong"]} THEN 'strong'
  WHEN lineage >= {s["lineage_strong"]} OR total >= {s["strong_score"]} THEN 'strong'
  WHEN (lineage > 0 OR hunk_overlap > 0) AND (minhash >= {s["strong_minhash"]} OR winnow >= {s["strong_winnow"]}) THEN 'strong'
  WHEN {prs} AND structure >= {ps["structure"]} AND semantic >= {ps["semantic"]} AND simhash >= {ps["simhash"]} AND title_salient >= {ps["title"]} THEN 'weak'
  WHEN structure <= 0 AND lineage <= 0 THEN CASE WHEN ({prs} AND title_salient >= {up["title"]} AND semantic_text >= {up["semantic_text"]} AND simhash >= {up["simhash"]})
    OR (hard_link >= {s["hard_link_weak"]} AND semantic >= {s["hard_link_semantic_weak"]}) OR (soft_link > 0 AND semantic >= {weak["semantic"]})
    OR (semantic >= {un["semantic"]} AND minhash >= {un["minhash"]} AND winnow >= {un["winnow"]}) THEN 'weak' END
  WHEN hard_link >= {s["hard_link_weak"]} AND (structure >= {weak["structure"]} OR semantic >= {s["hard_link_semantic_weak"]}) THEN 'weak'
  WHEN soft_link > 0 AND (structure >= {weak["structure"]} OR semantic >= {weak["semantic"]}) THEN 'weak'
  WHEN total >= {s["min_score"]} AND (structure >= {weak["structure"]} OR semantic >= {weak["semantic"]} OR minhash >= {weak["minhash"]} OR simhash >= {weak["simhash"]} OR winnow >= {weak["winnow"]}) THEN 'weak'
  END AS tier FROM score) WHERE tier IS NOT NULL)
"""


def chosen(cfg: dict[str, Any]) -> str:
    """The pairs that a run scores: above the floor of votes and within the best of an entity, or linked."""
    s = cfg["similarity"]
    floor = f"(CASE WHEN (SELECT count(*) FROM fp) >= {s['large_run_threshold']} THEN {s['min_votes_large']} ELSE {s['min_votes']} END)"
    if s["large_run_threshold"] is None:
        floor = s["min_votes"]
    return f"""SELECT DISTINCT least(entity_id, other) AS entity_a, greatest(entity_id, other) AS entity_b FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY votes DESC, other) AS place FROM met
  WHERE mandatory = 1 OR votes >= CASE WHEN entity_id IN (SELECT id FROM fp WHERE len(hard) > 0) THEN least({floor}, 1) ELSE {floor} END) WHERE place <= {s["top_k"]} OR mandatory = 1"""


def _reach(name: str, nodes: str, links: str) -> str:
    """View ``name`` (node, comp): the smallest node that links (x, y, both ways) reach; a node without links is its own."""
    return f""", {name}_l AS MATERIALIZED ({links}),
{name}_r AS (SELECT x AS node, x AS root FROM {name}_l UNION SELECT l.y, r.root FROM {name}_r r JOIN {name}_l l ON l.x = r.node),
{name} AS MATERIALIZED (SELECT n.node, coalesce(min(r.root), n.node) AS comp FROM ({nodes}) n LEFT JOIN {name}_r r ON r.node = n.node GROUP BY n.node)
"""


def pruned(grouped: str, edges: str, below: float, rounds: int = 12) -> str:
    """View g2: ``grouped`` (node, comp) without its weak tails, which are peeled ``rounds`` times; view peel_last holds
    what the last round peels, which is nothing where that was enough. edges: entity_a, entity_b, total, hard_link, lineage."""
    out = f""", big AS MATERIALIZED (SELECT node, comp FROM {grouped} WHERE comp IN (SELECT comp FROM {grouped} GROUP BY comp HAVING count(*) >= 3)),
i0 AS MATERIALIZED (SELECT p.node AS x, q.node AS y, p.comp, total, hard_link >= 0.5 OR lineage >= 0.5 AS firm
  FROM (SELECT entity_a, entity_b, total, hard_link, lineage FROM {edges} UNION ALL SELECT entity_b, entity_a, total, hard_link, lineage FROM {edges}) e
  JOIN big p ON p.node = e.entity_a JOIN big q ON q.node = e.entity_b AND q.comp = p.comp),
left_0 AS (SELECT node FROM big)
"""
    for k in range(rounds):
        out += f""", peel_{k} AS MATERIALIZED (SELECT n.node FROM left_{k} n LEFT JOIN (SELECT i0.* FROM i0 JOIN left_{k} z ON z.node = i0.y) e ON e.x = n.node
  GROUP BY n.node HAVING count(DISTINCT e.y) <= 1 AND NOT coalesce(bool_or(e.firm), false) AND coalesce(max(e.total), 0) < {below}),
left_{k + 1} AS MATERIALIZED (SELECT node FROM left_{k} WHERE node NOT IN (SELECT node FROM peel_{k}))
"""
    last = f"left_{rounds}"
    out += f""", peel_last AS (SELECT * FROM peel_{rounds - 1}), touched AS MATERIALIZED (SELECT DISTINCT comp FROM big WHERE node NOT IN (SELECT node FROM {last}))
"""
    out += _reach(
        "anew", f"SELECT node FROM big WHERE node IN (SELECT node FROM {last}) AND comp IN (SELECT comp FROM touched)",
        f"SELECT x, y FROM i0 WHERE comp IN (SELECT comp FROM touched) AND x IN (SELECT node FROM {last}) AND y IN (SELECT node FROM {last})",
    )
    return out + f""", g2 AS MATERIALIZED (SELECT node, comp FROM {grouped} WHERE comp NOT IN (SELECT comp FROM touched) UNION ALL SELECT node, comp FROM anew
  UNION ALL SELECT node, node FROM big WHERE node NOT IN (SELECT node FROM {last}))
"""


def clusters(cfg: dict[str, Any]) -> str:
    """Views g3 (node, comp) and types (cluster_id, component, n, cluster_type) of the edges."""
    s = cfg["similarity"]
    ways = lambda c: f"SELECT entity_a AS x, entity_b AS y FROM edge WHERE {c} UNION SELECT entity_b, entity_a FROM edge WHERE {c}"
    cohesive = f"""hard_link >= {s["split_hard_link"]} OR (lineage >= 0.5 AND (hunk_overlap >= {s["split_lineage_hunk"]} OR hard_link >= {s["split_hard_link"]}
  OR (title_salient >= {s["split_lineage_semantic"]} AND semantic_text >= {s["split_lineage_semantic"]}))) OR (title_salient >= {s["split_title"]} AND semantic_text >= {s["split_semantic_text"]})"""
    out = f""", st AS MATERIALIZED ({ways("tier = 'strong'")}), wk AS MATERIALIZED ({ways("tier = 'weak'")}),
fr AS (SELECT x FROM wk WHERE x NOT IN (SELECT x FROM st) GROUP BY x HAVING count(DISTINCT y) = 1),
mg AS MATERIALIZED (SELECT entity_a AS x, entity_b AS y FROM edge WHERE tier = 'strong' OR hard_link >= 0.5 OR lineage >= 0.5
  UNION SELECT e.entity_a, e.entity_b FROM edge e JOIN st p ON p.x = e.entity_a JOIN st q ON q.x = e.entity_b AND q.y = p.y WHERE e.tier = 'weak'
  UNION SELECT entity_a, entity_b FROM edge WHERE tier = 'weak' AND entity_a IN (SELECT x FROM fr) AND entity_b IN (SELECT x FROM fr))
"""
    out += _reach("g1", "SELECT id AS node FROM fp", "SELECT x, y FROM mg UNION SELECT y, x FROM mg")
    out += pruned("g1", "edge", s["cluster_tail_prune_score"])
    out += f""", wide AS MATERIALIZED (SELECT node, comp FROM g2 WHERE comp IN (SELECT comp FROM g2 GROUP BY comp HAVING count(*) >= {s["split_size"]})),
hold AS MATERIALIZED (SELECT entity_a AS x, entity_b AS y FROM edge JOIN wide p ON p.node = entity_a JOIN wide q ON q.node = entity_b AND q.comp = p.comp WHERE {cohesive})
"""
    out += _reach("part", "SELECT node FROM wide", "SELECT x, y FROM hold UNION SELECT y, x FROM hold")
    return out + """, g3 AS MATERIALIZED (SELECT node, comp FROM g2 WHERE node NOT IN (SELECT node FROM wide) UNION ALL SELECT node, comp FROM part),
hd AS (SELECT p.comp, max(hard_link) AS hard FROM edge JOIN g3 p ON p.node = entity_a JOIN g3 q ON q.node = entity_b AND q.comp = p.comp GROUP BY 1),
ct AS (SELECT comp, count(*) AS n, count(*) FILTER (node LIKE 'pr:%') AS prs, count(*) FILTER (node LIKE 'issue:%') AS issues FROM g3 GROUP BY 1),
types AS MATERIALIZED (SELECT 'cluster-' || row_number() OVER (ORDER BY n DESC, ct.comp) AS cluster_id, ct.comp AS component, n, CASE WHEN n = 1 THEN 'singleton_orphan' WHEN prs >= 2 OR issues >= 2 THEN 'duplicate_candidate'
  WHEN prs = 1 AND issues = 1 THEN CASE WHEN coalesce(hard, 0) >= 0.5 THEN 'linked_pair' ELSE 'mixed_pair' END WHEN prs > 0 AND issues > 0 THEN 'mixed_related' ELSE 'related_group' END AS cluster_type
  FROM ct LEFT JOIN hd ON hd.comp = ct.comp)
"""


def decisions(cfg: dict[str, Any]) -> str:
    """View dec: every member's state in its cluster and lane."""
    c, w = cfg["canonical"], cfg["canonical"]["weights"]
    evidence = f"""((lineage >= 0.5 AND (hard_link >= {c["duplicate_hard_link"]} OR hunk_overlap >= {c["duplicate_hunk"]} OR (title_salient >= {c["duplicate_title"]} AND semantic_text >= {c["duplicate_semantic_text"]})))
  OR (hard_link >= {c["duplicate_hard_link"]} AND (file_overlap >= {c["duplicate_hard_link_file"]} OR hunk_overlap >= {c["duplicate_hard_link_hunk"]} OR title_salient >= {c["duplicate_hard_link_title"]}))
  OR hunk_overlap >= {c["duplicate_hunk"]} OR (file_overlap >= {c["duplicate_file"]} AND title_salient >= {c["duplicate_file_title"]} AND semantic_text >= {c["duplicate_semantic_text"]}))"""
    veto = f"(lineage < 0.5 AND title_salient <= {c['veto_title']} AND semantic_text <= {c['veto_semantic_text']} AND hard_link < {c['veto_hard_link']})"
    near = f"(hard_link >= {c['tie_hard_link']} OR hunk_overlap >= {c['tie_hunk']} OR (file_overlap >= {c['tie_file']} AND semantic_text >= {c['tie_semantic_text']}))"
    metrics = ("lineage", "hunk_overlap", "file_overlap", "title_salient", "hard_link", "semantic_text", "total")
    return f""", mem AS MATERIALIZED (SELECT t.cluster_id, g3.node AS id FROM g3 JOIN types t ON t.component = g3.comp),
cent AS (SELECT p.cluster_id, p.id, sum(e.total) AS sims FROM (SELECT entity_a AS x, entity_b AS y, total FROM edge UNION ALL SELECT entity_b, entity_a, total FROM edge) e
  JOIN mem p ON p.id = e.x JOIN mem q ON q.id = e.y AND q.cluster_id = p.cluster_id GROUP BY 1, 2),
mf AS MATERIALIZED (SELECT DISTINCT cluster_id, id, file FROM (SELECT cluster_id, mem.id, unnest(changed_files) AS file FROM mem JOIN fp ON fp.id = mem.id)),
own AS (SELECT id, count(*) AS k FROM mf GROUP BY 1), every AS (SELECT cluster_id, count(DISTINCT file) AS k FROM mf GROUP BY 1), size AS (SELECT cluster_id, count(*) AS n FROM mem GROUP BY 1),
rs AS (SELECT mem.cluster_id, mem.id, string_split(mem.id, ':')[1] AS lane, {w["coverage"]} * coalesce(own.k::DOUBLE / every.k, 0.0) + {w["centrality"]} * coalesce(cent.sims, 0.0) / greatest(size.n - 1, 1)
  + {w["ci"]} * (CASE ci_status WHEN 'pass' THEN 1 WHEN 'fail' THEN -1 ELSE 0 END) + {w["approvals"]}::DOUBLE * least(1.0::DOUBLE, approvals / 3.0::DOUBLE) + {w["priority"]} * coalesce(priority_weight, 1.0)
  - {w["size_penalty"]} * least(1.0::DOUBLE, ln(1.0::DOUBLE + additions + deletions) / 8.0::DOUBLE) AS score
  FROM mem JOIN fp ON fp.id = mem.id JOIN size ON size.cluster_id = mem.cluster_id LEFT JOIN own ON own.id = mem.id LEFT JOIN every ON every.cluster_id = mem.cluster_id LEFT JOIN cent ON cent.id = mem.id),
rk AS (SELECT *, row_number() OVER w AS place, lag(score) OVER w - score AS behind, first_value(id) OVER w AS head FROM rs WINDOW w AS (PARTITION BY cluster_id, lane ORDER BY score DESC, id)),
rm AS (SELECT rk.*, {", ".join(f"coalesce(e.{m}, 0.0) AS {m}" for m in metrics)} FROM rk LEFT JOIN edge e ON e.entity_a = least(rk.id, rk.head) AND e.entity_b = greatest(rk.id, rk.head) AND rk.id <> rk.head),
rd AS (SELECT *, (total >= {c["duplicate_threshold"]} OR lineage >= 0.5) AND {evidence} AND NOT {veto} AS dup,
  place = 2 AND behind < {c["tie_margin"]} AND NOT {veto} AND total >= {c["tie_similarity"]} AND {near} AS tie FROM rm),
dec AS MATERIALIZED (SELECT cluster_id, id AS entity_id, lane, CASE WHEN place = 1 THEN 'canonical' WHEN dup THEN 'duplicate_of' WHEN tie THEN 'needs_human_tie_break' ELSE 'related_non_duplicate' END AS state,
  round(CASE WHEN place = 1 THEN score ELSE total END, 6) AS score, CASE WHEN place > 1 AND dup THEN head END AS duplicate_of, place AS lane_rank FROM rd)
"""


def routing(cfg: dict[str, Any]) -> str:
    """View rt: labels, queue, comment and closing of every entity; no noise rule here closes."""
    n = cfg["labels"]
    return f""", rj AS (SELECT f.id, f.kind, f.filter_state <> 'pass' AS noisy, d.state, d.duplicate_of, t.cluster_type, coalesce(t.n, 1) > 1 AS big, coalesce(t.n, 1) > 1 AND t.cluster_type = 'linked_pair' AS pair
  FROM f LEFT JOIN dec d ON d.entity_id = f.id LEFT JOIN types t ON t.cluster_id = d.cluster_id),
rt AS (SELECT id, CASE WHEN noisy THEN '{n["noise_suppressed"]},{n["quarantine"]}' ELSE array_to_string(list_sort(list_filter(['{n["ready_human"]}', CASE WHEN pair THEN '{n["linked_pair"]}'
    WHEN state = 'canonical' THEN CASE WHEN big THEN '{n["canonical"]}' END WHEN state = 'duplicate_of' THEN '{n["duplicate"]}' WHEN big THEN '{n["related"]}' END], lambda x: x IS NOT NULL)), ',') END AS labels,
  CASE WHEN noisy THEN 'quarantine' END AS queue_key, CASE WHEN noisy THEN NULL WHEN pair THEN CASE WHEN state = 'canonical' AND kind = 'pr' THEN 'Linked PR/issue pair for the same work item.' END
    WHEN state = 'canonical' THEN CASE WHEN big THEN 'Marked as canonical candidate for this similarity cluster.' END
    WHEN state = 'duplicate_of' THEN 'Potential duplicate of ' || duplicate_of || '; routed for maintainer confirmation.' END AS comment, false AS close FROM rj)
"""


#: View sw: which cluster a filtered-out entity joins.
SHADOWS = """, sl AS (SELECT DISTINCT mem.cluster_id, ref FROM mem JOIN (SELECT id, unnest(list_concat(hard, soft)) AS ref FROM fp) x ON x.id = mem.id),
sk AS (SELECT DISTINCT id, unnest(list_concat(list_concat(linked_issues, soft_linked_issues), CASE WHEN kind = 'issue' THEN [CAST(number AS VARCHAR)] ELSE []::VARCHAR[] END)) AS ref FROM f WHERE filter_state <> 'pass'),
sw AS (SELECT id FROM sk JOIN sl ON sl.ref = sk.ref GROUP BY 1)
"""
