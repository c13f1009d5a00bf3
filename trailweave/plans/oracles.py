"""Plain SQL with the result of each registered query, for the comparison in DuckDB.

The statements take the direct road (one global window, transitive closures, a queue
walked pair by pair) and share nothing with the operators but the definitions.
"""

from __future__ import annotations

LOG = """log AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS case_id, ts,
         event_type || '_' || CAST(CAST(floor(log2(value + 1)) AS BIGINT) AS VARCHAR) AS activity,
         event_type AS cluster
  FROM events)"""
FINE_LOG = """log AS (
  SELECT event_id, ts, event_type || '_' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS activity FROM events)"""
NODES = "nodes AS (SELECT DISTINCT activity FROM log)"
FREQ = "freq AS (SELECT activity, count(*) AS freq FROM log GROUP BY activity)"


def _follow(name: str, window: str, source: str = "log", activity: str = "activity") -> str:
    return f"""{name} AS (
  SELECT src, dst, count(*) AS cnt FROM (
    SELECT {activity} AS src, lead({activity}) OVER ({window}) AS dst FROM {source})
  WHERE dst IS NOT NULL GROUP BY src, dst)"""


DFG = _follow("dfg", "ORDER BY ts, event_id")
BY_CASE = _follow("by_case", "PARTITION BY case_id ORDER BY ts, event_id")
BY_DAY = _follow("all_days", "PARTITION BY strftime(ts, '%Y%m%d') ORDER BY ts, event_id") + """,
by_day AS (SELECT * FROM all_days WHERE src <> dst AND cnt >= 2)"""
BY_ORDER = _follow(
    "by_order",
    "PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey",
    "lineitem",
    "('part_' || CAST(l_partkey AS VARCHAR))",
)
NEAR = """near AS (
  SELECT src, dst, count(*) AS cnt FROM (
    SELECT activity AS src, unnest([lag(activity) OVER w, lead(activity) OVER w, lead(activity, 2) OVER w]) AS dst
    FROM log WINDOW w AS (ORDER BY ts, event_id))
  WHERE dst IS NOT NULL GROUP BY src, dst)"""


def _totals(edges: str, name: str = "totals") -> str:
    return f"{name} AS (SELECT src, dst, cnt, CAST(sum(cnt) OVER (PARTITION BY src) AS BIGINT) AS total FROM {edges})"


def _windowed(decay: float = 0.001, least: float | None = None) -> str:
    lasts = "" if least is None else f" AND exp(-{decay} * (y.sec - x.sec)) > {least}"
    return f"""numbered AS (
  SELECT activity, CAST(floor(epoch_us(ts) / 6e8) AS BIGINT) AS win, CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) AS sec,
         row_number() OVER (ORDER BY ts, event_id) AS rn
  FROM log),
windowed AS (
  SELECT x.activity AS src, y.activity AS dst, count(*) AS cnt, sum(exp(-{decay} * (y.sec - x.sec))) AS weight
  FROM numbered x JOIN numbered y ON x.win = y.win AND x.rn < y.rn{lasts} GROUP BY ALL)"""


WINDOWED = _windowed()


def _components(nodes: str, edges: str, name: str = "comp") -> str:
    """Undirected components by closure of reachability: (v, label)."""
    return f"""{name}_reach(v, w) AS (
  SELECT activity, activity FROM {nodes}
  UNION
  SELECT r.v, e.dst FROM {name}_reach r JOIN (
    SELECT src, dst FROM {edges} UNION ALL SELECT dst, src FROM {edges}) e ON r.w = e.src),
{name} AS (SELECT v, min(w) AS label FROM {name}_reach GROUP BY v)"""


def _spread_minima(nodes: str, edges: str, name: str = "comp") -> str:
    """Components over edges in both directions: the smallest name wanders until nothing changes."""
    return f"""{name}_round(k, v, label, moved) AS (
  SELECT 0, activity, activity, true FROM {nodes}
  UNION ALL
  SELECT k + 1, v, label, bool_or(label < was) OVER () FROM (
    SELECT r.k, r.v, r.label AS was, least(r.label, coalesce(min(s.label), r.label)) AS label
    FROM (SELECT * FROM {name}_round WHERE moved) r LEFT JOIN {edges} e ON e.dst = r.v LEFT JOIN {name}_round s ON s.v = e.src
    GROUP BY r.k, r.v, r.label)),
{name} AS (SELECT v, label FROM {name}_round WHERE k = (SELECT max(k) FROM {name}_round))"""


def _min_label(nodes: str, edges: str, name: str = "minl", rounds: int = 10, key: bool = False) -> str:
    """Smallest vertex that reaches v in at most ``rounds`` steps, unrolled."""
    t, on, tid = ("tid, ", "s.tid = e.tid AND ", "s.tid, ") if key else ("", "", "")
    parts = [f"{name}0 AS (SELECT {t}activity AS v, activity AS label FROM {nodes})"]
    for i in range(1, rounds + 1):
        parts.append(f"""{name}{i} AS MATERIALIZED (
  SELECT {t}v, min(label) AS label FROM (
    SELECT {t}v, label FROM {name}{i - 1}
    UNION ALL
    SELECT {tid}e.dst, s.label FROM {name}{i - 1} s JOIN {edges} e ON {on}s.v = e.src)
  GROUP BY {t}v)""")
    parts.append(f"{name} AS (SELECT * FROM {name}{rounds})")
    return ",\n".join(parts)


def _votes(nodes: str, edges: str, rounds: int, count: str = "1", name: str = "lpa") -> str:
    """Synchronous majority labels, ties to the smallest label, unrolled."""
    parts = [
        f"""both_ways AS MATERIALIZED (
  SELECT src, dst, {count} AS votes FROM {edges} UNION ALL SELECT dst, src, {count} FROM {edges})""",
        f"{name}0 AS (SELECT activity AS v, activity AS label FROM {nodes})",
    ]
    for i in range(1, rounds + 1):
        parts.append(f"""{name}{i} AS MATERIALIZED (
  SELECT s.v, coalesce(best.label, s.label) AS label FROM {name}{i - 1} s LEFT JOIN (
    SELECT v, label FROM (
      SELECT e.dst AS v, p.label, row_number() OVER (PARTITION BY e.dst ORDER BY sum(e.votes) DESC, p.label) AS rn
      FROM both_ways e JOIN {name}{i - 1} p ON e.src = p.v GROUP BY e.dst, p.label)
    WHERE rn = 1) best ON s.v = best.v)""")
    parts.append(f"{name} AS (SELECT * FROM {name}{rounds})")
    return ",\n".join(parts)


def _ends(edges: str, name: str = "ends") -> str:
    return f"{name} AS (SELECT src AS activity FROM {edges} UNION SELECT dst FROM {edges})"


FREQUENT = "frequent AS (SELECT src, dst, cnt FROM dfg WHERE cnt >= 9)"
BASE = f"{LOG},\n{NODES},\n{DFG}"
COMPONENTS = f"{BASE},\n{FREQUENT},\n{_components('nodes', 'frequent')}"
CLUSTERS = "clusters AS (SELECT label AS cluster_id, v AS activity FROM comp)"
SWEEP = f"""{_totals('dfg')},
tid_nodes AS (SELECT CAST(range AS INTEGER) AS tid, activity FROM range(1, 21), nodes),
tid_edges AS MATERIALIZED (
  SELECT CAST(range AS INTEGER) AS tid, src, dst FROM totals JOIN range(1, 21) ON cnt * 20 >= range * total),
{_min_label('tid_nodes', 'tid_edges', 'swept', key=True)}"""


def _with(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n"


def _tie(one: str, other: str) -> str:
    return f"CAST('0x' || substr(md5({one} || '/' || {other}), 1, 13) AS BIGINT)"


def _queue(pairs: str, cap: int, stop_at: int, tie: str | None = None) -> str:
    """Walk the pair queue one by one; the state is the list of every activity's cluster."""
    tie = _tie("p.src", "p.dst") if tie is None else tie
    return f"""names AS (
  SELECT activity, row_number() OVER (ORDER BY activity) AS i FROM (
    SELECT src AS activity FROM {pairs} UNION SELECT dst FROM {pairs})),
queue AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY p.cnt DESC, {tie}, p.src, p.dst) AS k, x.i AS a, y.i AS b, p.src, p.dst, p.cnt
  FROM {pairs} p JOIN names x ON p.src = x.activity JOIN names y ON p.dst = y.activity
  WHERE p.cnt >= 2 AND p.src <> p.dst),
walk(k, lab, live, merged) AS (
  SELECT CAST(0 AS BIGINT), (SELECT list(i ORDER BY i) FROM names), (SELECT count(*) FROM names), false
  UNION ALL
  SELECT q.k,
         CASE WHEN fits THEN list_transform(w.lab, lambda x: CASE WHEN x = greatest(la, lb) THEN least(la, lb) ELSE x END)
              ELSE w.lab END,
         CASE WHEN fits THEN w.live - 1 ELSE w.live END,
         fits
  FROM (SELECT w.*, q.k AS qk, w.lab[q.a] AS la, w.lab[q.b] AS lb,
               w.live > {stop_at} AND w.lab[q.a] <> w.lab[q.b]
               AND len(list_filter(w.lab, lambda x: x = w.lab[q.a])) + len(list_filter(w.lab, lambda x: x = w.lab[q.b])) <= {cap}
               AS fits
        FROM walk w JOIN queue q ON q.k = w.k + 1) w
  JOIN queue q ON q.k = w.qk)"""


def _greedy(edges_cte: str, pairs: str, cap: int) -> str:
    return _with(LOG, edges_cte, _queue(pairs, cap, 15), recursive=True) + """,
last AS (SELECT lab FROM walk ORDER BY k DESC LIMIT 1),
placed AS (SELECT n.activity, (SELECT lab FROM last)[n.i] AS c FROM names n)
SELECT min(activity) OVER (PARTITION BY c) AS cluster_id, activity FROM placed""".lstrip()


FOREST = """undirected AS MATERIALIZED (
  SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(cnt) AS cnt FROM dfg WHERE src <> dst GROUP BY 1, 2)"""


def _flow(rounds: int = 15) -> str:
    parts = [_totals("dfg"), "flow0 AS (SELECT activity, CAST(1.0 AS DOUBLE) AS score FROM nodes)"]
    for i in range(1, rounds + 1):
        parts.append(f"""flow{i} AS MATERIALIZED (
  SELECT s.activity, CASE WHEN f.inflow IS NULL THEN s.score ELSE 0.85 * f.inflow + (1 - 0.85) * s.score END AS score
  FROM flow{i - 1} s LEFT JOIN (
    SELECT e.dst, sum(p.score * e.cnt / e.total) AS inflow FROM totals e JOIN flow{i - 1} p ON e.src = p.activity
    GROUP BY e.dst) f ON f.dst = s.activity)""")
    return ",\n".join(parts) + f",\nflow AS (SELECT * FROM flow{rounds})"


def _walks(count: int, length: int, seed: int = 7) -> str:
    """Walks with the draws of the operator, unrolled; pairs counted after every step."""
    parts = [
        _totals("dfg"),
        "places AS (SELECT activity, row_number() OVER (ORDER BY activity) AS place FROM nodes)",
        """spans AS MATERIALIZED (
  SELECT src, dst, total, CAST(sum(cnt) OVER (PARTITION BY src ORDER BY cnt, dst ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hi,
         cnt FROM totals)""",
        "sums AS (SELECT DISTINCT src, total FROM totals)",
        f"""walk0 AS (
  SELECT activity AS start, CAST(range AS INTEGER) AS walk, activity AS cur, [activity] AS seen, false AS won
  FROM nodes, range(1, {count + 1}))""",
    ]
    for k in range(1, length + 1):
        u = (
            f"CAST('0x' || substr(md5(w.start || '|' || w.walk || '|{k}|{seed}'), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE"
        )
        parts.append(f"""walk{k} AS MATERIALIZED (
  SELECT d.start, d.walk, coalesce(s.dst, p.activity) AS cur,
         CASE WHEN s.dst IS NULL OR list_contains(d.seen, s.dst) THEN d.seen ELSE list_append(d.seen, s.dst) END AS seen,
         s.dst IS NOT NULL AS won
  FROM (SELECT w.*, t.total, CAST(floor({u} * coalesce(t.total, (SELECT count(*) FROM nodes))) AS BIGINT) AS draw
        FROM walk{k - 1} w LEFT JOIN sums t ON t.src = w.cur) d
  LEFT JOIN spans s ON s.src = d.cur AND d.draw >= s.hi - s.cnt AND d.draw < s.hi
  LEFT JOIN places p ON d.total IS NULL AND p.place = d.draw + 1)""")
    union = "\n  UNION ALL\n  ".join(
        f"SELECT a, unnest(seen) AS b FROM (SELECT seen, unnest(seen) AS a FROM walk{k} WHERE won)"
        for k in range(1, length + 1)
    )
    parts.append(f"met AS MATERIALIZED (\n  SELECT a, b, 2 * count(*) AS cnt FROM (\n  {union}) WHERE a < b GROUP BY a, b)")
    return ",\n".join(parts)


SCORED_SETS = f"""{FREQUENT},
{_components('nodes', 'frequent')},
{SWEEP},
members AS (
  SELECT 'components' AS name, label AS cluster_id, v AS activity FROM comp
  UNION ALL SELECT 'strong_05', label, v FROM swept WHERE tid = 1
  UNION ALL SELECT 'strong_10', label, v FROM swept WHERE tid = 2),
predicted AS MATERIALIZED (
  SELECT * FROM (SELECT name, cluster_id, activity AS src,
                        lead(activity) OVER (PARTITION BY name, cluster_id ORDER BY activity) AS dst FROM members)
  WHERE dst IS NOT NULL)"""
TRUTH = """seen_in AS (
  SELECT cluster, activity, min(event_id) AS first FROM log GROUP BY ALL),
known AS MATERIALIZED (
  SELECT * FROM (SELECT cluster AS cluster_id, activity AS src,
                        lead(activity) OVER (PARTITION BY cluster ORDER BY first) AS dst,
                        min(first) OVER (PARTITION BY cluster) AS born FROM seen_in)
  WHERE dst IS NOT NULL)"""
CHAIN = """chain AS (
  SELECT * FROM (SELECT activity AS src, lead(activity) OVER (ORDER BY first) AS dst
                 FROM (SELECT activity, min(event_id) AS first FROM log GROUP BY activity))
  WHERE dst IS NOT NULL)"""
CONTINGENCY = """known1 AS (SELECT src, dst, arg_max(cluster_id, born) AS truth FROM known GROUP BY ALL),
guess1 AS (SELECT name, src, dst, max(cluster_id) AS predicted FROM predicted GROUP BY ALL),
sets AS (SELECT DISTINCT name FROM members),
contingency AS MATERIALIZED (
  SELECT coalesce(k.name, g.name) AS name, coalesce(truth, '-1') AS truth, coalesce(predicted, '-1') AS predicted, count(*) AS n
  FROM (SELECT * FROM known1, sets) k FULL JOIN guess1 g ON k.name = g.name AND k.src = g.src AND k.dst = g.dst
  GROUP BY ALL)"""
MAPPING = f"""overlap AS MATERIALIZED (
  SELECT row_number() OVER (PARTITION BY name ORDER BY n DESC, {_tie("predicted", "truth")}, predicted, truth) AS k, name, predicted, truth
  FROM contingency WHERE truth <> '-1' AND predicted <> '-1'),
pick(name, k, ps, ts, predicted, truth) AS (
  SELECT name, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM sets
  UNION ALL
  SELECT p.name, o.k,
         CASE WHEN free THEN list_append(p.ps, o.predicted) ELSE p.ps END,
         CASE WHEN free THEN list_append(p.ts, o.truth) ELSE p.ts END,
         CASE WHEN free THEN o.predicted END, CASE WHEN free THEN o.truth END
  FROM (SELECT p.*, q.k AS qk, NOT list_contains(p.ps, q.predicted) AND NOT list_contains(p.ts, q.truth) AS free
        FROM pick p JOIN overlap q ON q.name = p.name AND q.k = p.k + 1) p
  JOIN overlap o ON o.name = p.name AND o.k = p.qk),
picked AS (SELECT name, predicted, truth FROM pick WHERE predicted IS NOT NULL),
mapping AS MATERIALIZED (
  SELECT * FROM picked
  UNION ALL
  SELECT x.name, x.predicted, y.truth
  FROM (SELECT name, predicted, row_number() OVER (PARTITION BY name ORDER BY predicted) AS i
        FROM (SELECT DISTINCT name, predicted FROM contingency WHERE predicted <> '-1') c
        WHERE NOT EXISTS (SELECT 1 FROM picked p WHERE p.name = c.name AND p.predicted = c.predicted)) x
  JOIN (SELECT name, truth, row_number() OVER (PARTITION BY name ORDER BY truth) AS i
        FROM (SELECT DISTINCT name, truth FROM contingency WHERE truth <> '-1') c
        WHERE NOT EXISTS (SELECT 1 FROM picked p WHERE p.name = c.name AND p.truth = c.truth)) y
  ON x.name = y.name AND x.i = y.i)"""
METRICS = """final AS MATERIALIZED (
  SELECT c.name, c.truth, coalesce(m.truth, '-1') AS predicted, CAST(sum(n) AS DOUBLE) AS n
  FROM contingency c LEFT JOIN mapping m ON m.name = c.name AND m.predicted = c.predicted GROUP BY ALL),
nt AS (SELECT name, truth, sum(n) AS c FROM final GROUP BY ALL),
np AS (SELECT name, predicted, sum(n) AS c FROM final GROUP BY ALL),
nn AS (SELECT name, sum(n) AS c FROM final GROUP BY ALL),
nmi AS (
  SELECT x.name, CASE WHEN ht + hp = 0 THEN 1.0 WHEN abs(mi) < 1e-12 THEN 0.0 ELSE mi / ((ht + hp) / 2) END AS nmi
  FROM (SELECT f.name, sum(f.n / nn.c * ln(f.n * nn.c / (nt.c * np.c))) AS mi
        FROM final f JOIN nt USING (name, truth) JOIN np USING (name, predicted) JOIN nn ON nn.name = f.name GROUP BY f.name) x
  JOIN (SELECT nt.name, -sum(nt.c / nn.c * ln(nt.c / nn.c)) AS ht FROM nt JOIN nn ON nn.name = nt.name GROUP BY nt.name) y ON x.name = y.name
  JOIN (SELECT np.name, -sum(np.c / nn.c * ln(np.c / nn.c)) AS hp FROM np JOIN nn ON nn.name = np.name GROUP BY np.name) z ON x.name = z.name),
ari AS (
  SELECT a.name, CASE WHEN s = t AND s = p THEN 1.0 ELSE (s - t * p / e) / ((t + p) / 2 - t * p / e) END AS ari
  FROM (SELECT name, sum(n * (n - 1) / 2) AS s FROM final GROUP BY name) a
  JOIN (SELECT name, sum(c * (c - 1) / 2) AS t FROM nt GROUP BY name) b ON a.name = b.name
  JOIN (SELECT name, sum(c * (c - 1) / 2) AS p FROM np GROUP BY name) c ON a.name = c.name
  JOIN (SELECT name, c * (c - 1) / 2 AS e FROM nn) d ON a.name = d.name),
f1 AS (
  SELECT nt.name, sum(2 * coalesce(f.n, 0) / (nt.c + coalesce(np.c, 0)) * nt.c / nn.c) AS f1
  FROM nt JOIN nn ON nn.name = nt.name
  LEFT JOIN final f ON f.name = nt.name AND f.truth = nt.truth AND f.predicted = nt.truth
  LEFT JOIN np ON np.name = nt.name AND np.predicted = nt.truth GROUP BY nt.name)"""
COMMON = """total AS (SELECT count(*) AS total FROM known),
both_directions AS (
  SELECT s.name, count(p.src) AS found FROM (SELECT DISTINCT name FROM members) s CROSS JOIN known k
  LEFT JOIN predicted p ON p.name = s.name AND least(p.src, p.dst) = least(k.src, k.dst) AND greatest(p.src, p.dst) = greatest(k.src, k.dst)
  GROUP BY s.name),
one_direction AS (
  SELECT s.name, count(p.src) AS found FROM (SELECT DISTINCT name FROM members) s CROSS JOIN known k
  LEFT JOIN predicted p ON p.name = s.name AND p.src = k.src AND p.dst = k.dst GROUP BY s.name)"""
CONFUSION = """judged AS (
  SELECT s.name,
         EXISTS (SELECT 1 FROM known k WHERE (k.src = c.src AND k.dst = c.dst) OR (k.src = c.dst AND k.dst = c.src)) AS t,
         EXISTS (SELECT 1 FROM predicted p WHERE p.name = s.name AND
                 ((p.src = c.src AND p.dst = c.dst) OR (p.src = c.dst AND p.dst = c.src))) AS g
  FROM chain c CROSS JOIN (SELECT DISTINCT name FROM members) s),
confusion AS (
  SELECT name, count(*) FILTER (t AND g) AS tp, count(*) FILTER (t AND NOT g) AS fp, count(*) FILTER (NOT t AND g) AS fn,
         count(*) FILTER (NOT t AND NOT g) AS tn, count(*) AS pairs FROM judged GROUP BY name)"""
RANKED = """SELECT b.name, found AS found_relationships,
  round(found / total, 9) AS ratio_found, round(nmi, 9) AS nmi, round(ari, 9) AS ari, round(f1, 9) AS f1,
  round((tp + tn) / pairs, 9) AS accuracy, round(tp / pairs, 9) AS custom_found
FROM both_directions b CROSS JOIN total JOIN nmi ON nmi.name = b.name JOIN ari ON ari.name = b.name JOIN f1 ON f1.name = b.name
JOIN confusion c ON c.name = b.name ORDER BY custom_found DESC, b.name"""
SCORING = (BASE, SCORED_SETS, TRUTH, CONTINGENCY, MAPPING, METRICS)
SHARED = """together AS MATERIALIZED (
  SELECT x.v AS a, y.v AS b, 2 * count(*) AS cnt FROM swept x JOIN swept y ON x.tid = y.tid AND x.label = y.label AND x.v < y.v
  GROUP BY ALL HAVING 2 * count(*) > 10)"""
SIMPLE_SWEEP = f"{BASE},\n{SWEEP}"
FINE_SWEEP = f"{FINE_LOG},\n{NODES},\n{DFG},\n{SWEEP}"

ORACLES: dict[str, str] = {
    "event_log": _with(LOG) + "SELECT * FROM log",
    "activity_frequency": _with(LOG, FREQ) + "SELECT * FROM freq",
    "dfg_vertices": _with(LOG, NODES) + "SELECT * FROM nodes",
    "dfg_global": _with(LOG, DFG) + "SELECT * FROM dfg",
    "transition_counts": _with(LOG, DFG) + "SELECT * FROM dfg ORDER BY cnt DESC, src, dst",
    "transition_probabilities": _with(LOG, DFG, _totals("dfg")) + "SELECT *, round(cnt / total, 9) AS probability FROM totals",
    "dfg_by_case": _with(LOG, BY_CASE) + "SELECT * FROM by_case",
    "dfg_by_day": _with(LOG, BY_DAY) + "SELECT * FROM by_day",
    "dfg_by_order": _with(BY_ORDER) + "SELECT * FROM by_order",
    "dfg_by_conversation": _with(_follow("f", "PARTITION BY conv_id ORDER BY turn", "conversations", "role")) + "SELECT * FROM f",
    "row_numbers": "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS row_number FROM events",
    "neighbourhood_pairs": _with(LOG, NEAR) + "SELECT * FROM near",
    "frequent_transitions": _with(LOG, DFG) + "SELECT * FROM dfg WHERE cnt >= 9",
    "strong_transitions": _with(LOG, DFG, _totals("dfg")) + "SELECT * FROM totals WHERE cnt * 20 >= total",
    "log_weights": _with(LOG, BY_DAY) + "SELECT *, round(ln(cnt + 1), 9) AS weight FROM by_day",
    "java_hash_ids": _with(LOG, NODES) + """,
h AS (SELECT activity, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(activity, ''), lambda c: CAST(unicode(c) AS BIGINT))),
        lambda x, y: (x * 31 + y) % 4294967296) AS u FROM nodes)
SELECT activity, CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END AS id FROM h""".lstrip(),
    "window_pairs": _with(LOG, WINDOWED) + "SELECT src, dst, cnt FROM windowed",
    "decay_weights": _with(LOG, WINDOWED) + "SELECT src, dst, cnt, round(weight, 6) AS weight FROM windowed",
    "frequent_components": _with(COMPONENTS, recursive=True) + "SELECT label AS cluster_id, v AS activity FROM comp",
    "part_components": _with(
        BY_ORDER, _ends("by_order", "nodes"), "repeated AS MATERIALIZED (SELECT src, dst FROM by_order WHERE cnt >= 2)",
        _components("nodes", "repeated"), recursive=True,
    ) + "SELECT label AS cluster_id, v AS activity FROM comp",
    "component_count_sweep": _with(
        BASE,
        "levels AS (SELECT CAST(range AS INTEGER) AS t FROM range(0, 101))",
        """reach(t, v, w) AS (
  SELECT t, activity, activity FROM levels, nodes
  UNION
  SELECT r.t, r.v, e.dst FROM reach r JOIN (SELECT src, dst, cnt FROM dfg UNION ALL SELECT dst, src, cnt FROM dfg) e
  ON r.w = e.src AND e.cnt >= r.t)""",
        recursive=True,
    ) + """SELECT t AS threshold, count(DISTINCT label) AS components
FROM (SELECT t, v, min(w) AS label FROM reach GROUP BY t, v) GROUP BY t""",
    "max_spanning_forest": _with(BASE, FOREST, _queue("undirected", 1 << 30, 0, "p.src").replace("p.cnt >= 2 AND ", ""), recursive=True)
    + "SELECT q.src AS a, q.dst AS b, q.cnt FROM walk w JOIN queue q ON q.k = w.k WHERE w.merged",
    "scc": _with(
        LOG, NODES, BY_CASE, _totals("by_case"), "strong AS MATERIALIZED (SELECT src, dst FROM by_case)",
        """reach(v, w) AS (
  SELECT activity, activity FROM nodes UNION SELECT r.v, e.dst FROM reach r JOIN strong e ON r.w = e.src)""",
        recursive=True,
    ) + "SELECT min(x.w) AS cluster_id, x.v AS activity FROM reach x JOIN reach y ON x.v = y.w AND x.w = y.v GROUP BY x.v",
    "lpa_dfg": _with(LOG, BY_CASE, _ends("by_case"), _votes("ends", "by_case", 5))
    + "SELECT label AS cluster_id, v AS activity FROM lpa WHERE v IN (SELECT src FROM by_case)",
    "lpa_global": _with(BASE, _votes("nodes", "dfg", 10)) + "SELECT label AS cluster_id, v AS activity FROM lpa",
    "lpa_window": _with(LOG, NODES, WINDOWED, _votes("nodes", "windowed", 5, "cnt"))
    + "SELECT label AS cluster_id, v AS activity FROM lpa",
    "lpa_daily": _with(LOG, BY_DAY, _ends("by_day"), _votes("ends", "by_day", 5))
    + "SELECT label AS cluster_id, v AS activity FROM lpa",
    "refined_clusters": _with(
        LOG, FREQ, BY_DAY, _ends("by_day"), _votes("ends", "by_day", 5),
        """placed AS (
  SELECT label, v, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY v) AS rn FROM lpa),
parts AS (SELECT label, CASE WHEN n > 10 THEN (rn - 1) // 5 ELSE 0 END AS part, v FROM placed WHERE n >= 2)""",
    ) + """SELECT first_value(v) OVER (PARTITION BY label, part ORDER BY freq DESC, v DESC) AS cluster_id, v AS activity
FROM parts JOIN freq ON freq.activity = parts.v""",
    "cluster_names": _with(COMPONENTS, FREQ, recursive=True) + """SELECT label AS cluster_id,
  arg_max(v, lpad(CAST(freq AS VARCHAR), 20, '0') || v) AS name, count(*) AS members
FROM comp JOIN freq ON freq.activity = comp.v GROUP BY label""",
    "min_label_communities": _with(BASE, _min_label("nodes", "dfg"))
    + "SELECT label AS cluster_id, v AS activity FROM minl",
    "flow_score": _with(BASE, _flow()) + "SELECT activity, round(score, 6) AS score FROM flow",
    "flow_groups": _with(BASE, _flow()) + """SELECT CAST(floor(score * 1000 + 0.5) AS INTEGER) AS score,
  string_agg(activity, ',' ORDER BY activity) AS activities FROM flow GROUP BY 1""",
    "greedy_merge": _greedy(DFG, "dfg", 4),
    "greedy_merge_neighbourhood": _greedy(NEAR, "near", 6),
    "threshold_communities": _with(SIMPLE_SWEEP) + "SELECT tid, label AS cluster_id, v AS activity FROM swept",
    "threshold_clusters_nested": _with(SIMPLE_SWEEP) + """SELECT round(tid / 20, 4) AS threshold, label AS community,
  string_agg(v, ',' ORDER BY v) AS members FROM swept GROUP BY tid, label""",
    "consensus_pairs": _with(FINE_SWEEP, SHARED) + "SELECT * FROM together",
    "consensus_clusters": _with(
        FINE_SWEEP, SHARED, "paired AS (SELECT a AS src, b AS dst FROM together)", _ends("paired"),
        _components("ends", "paired"), recursive=True,
    ) + "SELECT label AS cluster_id, v AS activity FROM comp",
    "membership_strength": _with(SIMPLE_SWEEP)
    + "SELECT v AS activity, label AS cluster_id, CAST(count(*) AS INTEGER) AS strength FROM swept GROUP BY v, label",
    "overlapping_clusters": _with(
        SIMPLE_SWEEP, "strengths AS (SELECT v, label, count(*) AS strength FROM swept GROUP BY v, label)",
    ) + """SELECT CAST(range AS INTEGER) AS min_strength, label AS cluster_id, v AS activity
FROM range(0, 21) JOIN strengths ON strength >= range WHERE range <= (SELECT max(strength) FROM strengths)""",
    "aggregated_clusters": _with(
        FINE_SWEEP,
        """stars AS MATERIALIZED (
  SELECT DISTINCT v, min(v) OVER (PARTITION BY tid, label) AS head FROM swept WHERE tid >= 1),
sharing AS MATERIALIZED (SELECT v AS src, head AS dst FROM stars WHERE v <> head UNION SELECT head, v FROM stars WHERE v <> head)""",
        _spread_minima("nodes", "sharing"), recursive=True,
    ) + "SELECT label AS cluster_id, v AS activity FROM comp",
    "walk_cooccurrence": _with(BASE, _walks(100, 2)) + "SELECT * FROM met",
    "walk_clusters": _with(
        BASE, _walks(100, 2), "often AS MATERIALIZED (SELECT a AS src, b AS dst FROM met WHERE cnt >= 50)", _ends("often"),
        _components("ends", "often"), recursive=True,
    ) + "SELECT label AS cluster_id, v AS activity FROM comp",
    "walk_min_label": _with(
        BASE, _walks(1000, 10), "often AS MATERIALIZED (SELECT a AS src, b AS dst FROM met WHERE cnt >= 850)",
        _min_label("nodes", "often"),
    ) + "SELECT label AS cluster_id, v AS activity FROM minl",
    "walk_threshold_sweep": _with(
        BASE, _walks(1000, 10),
        "walk_nodes AS (SELECT CAST(range AS INTEGER) AS tid, activity FROM range(2, 21), nodes)",
        """often AS MATERIALIZED (
  SELECT CAST(range AS INTEGER) AS tid, a AS src, b AS dst FROM range(2, 21) JOIN met ON cnt >= range * 1000 // 20)""",
        _min_label("walk_nodes", "often", key=True),
    ) + "SELECT tid, label AS cluster_id, v AS activity FROM minl",
    "truth_edges": _with(LOG, TRUTH) + "SELECT cluster_id, src, dst FROM known",
    "commonality": _with(BASE, SCORED_SETS, TRUTH, COMMON, recursive=True) + """SELECT name, found, total, round(found / total, 9) AS ratio, 0 AS directed FROM both_directions, total
UNION ALL SELECT name, found, total, round(found / total, 9), 1 FROM one_direction, total""",
    "chain_accuracy": _with(BASE, SCORED_SETS, TRUTH, CHAIN, CONFUSION, recursive=True)
    + "SELECT name, tp, fp, fn, tn, round((tp + tn) / pairs, 9) AS accuracy, round(tp / pairs, 9) AS custom FROM confusion",
    "label_contingency": _with(*SCORING[:4], recursive=True) + "SELECT * FROM contingency",
    "label_mapping": _with(*SCORING[:5], recursive=True) + "SELECT * FROM mapping",
    "nmi": _with(*SCORING, recursive=True) + "SELECT name, round(nmi, 9) AS nmi FROM nmi",
    "ari": _with(*SCORING, recursive=True) + "SELECT name, round(ari, 9) AS ari FROM ari",
    "weighted_f1": _with(*SCORING, recursive=True) + "SELECT name, round(f1, 9) AS f1 FROM f1",
    "score_all": _with(*SCORING, COMMON, CHAIN, CONFUSION, recursive=True) + RANKED,
    "cluster_lines": _with(COMPONENTS, recursive=True)
    + "SELECT label || ':' || string_agg(v, ',' ORDER BY v) AS value FROM comp GROUP BY label",
    "cluster_json": _with(COMPONENTS, recursive=True) + "SELECT string_agg(v, ',' ORDER BY v) AS members FROM comp GROUP BY label",
    "cluster_file_edges": _with(COMPONENTS, recursive=True) + """SELECT * FROM (
  SELECT label AS cluster_id, v AS src, lead(v) OVER (PARTITION BY label ORDER BY v) AS dst FROM comp) WHERE dst IS NOT NULL""",
    "numbered_clusters": _with(COMPONENTS, recursive=True)
    + "SELECT dense_rank() OVER (ORDER BY label) - 1 AS cluster_id, v AS activity FROM comp",
}
# Strong transitions of fine activities: many small clusters.
TIED = f"{FINE_LOG},\n{NODES},\n{DFG},\n{_totals('dfg')},\ntied AS MATERIALIZED (SELECT src, dst, cnt FROM totals WHERE cnt * 20 >= total * 2)"
PARTS_TIED = (
    f"{BY_ORDER},\n{_ends('by_order', 'nodes')},\n{_totals('by_order')},\n"
    "tied AS MATERIALIZED (SELECT src, dst, cnt FROM totals WHERE cnt * 20 >= total)"
)
REACH = """reach(v, w) AS (
  SELECT activity, activity FROM nodes UNION SELECT r.v, e.dst FROM reach r JOIN tied e ON r.w = e.src)"""
STRONG = "SELECT min(x.w) AS cluster_id, x.v AS activity FROM reach x JOIN reach y ON x.v = y.w AND x.w = y.v GROUP BY x.v"

ORACLES |= {
    "fading_pairs": _with(LOG, _windowed(0.01, 0.01)) + "SELECT src, dst, cnt, round(weight, 6) AS weight FROM windowed",
    "lpa_window_fine": _with(FINE_LOG, NODES, WINDOWED, "often AS (SELECT src, dst, cnt FROM windowed WHERE cnt >= 2)", _votes("nodes", "often", 5, "cnt"))
    + "SELECT label AS cluster_id, v AS activity FROM lpa",
    "walk_clusters_fine": _with(
        TIED, _walks(100, 2).replace("totals AS", "tied_totals AS").replace("FROM dfg)", "FROM tied)").replace("FROM totals", "FROM tied_totals"),
        "often AS MATERIALIZED (SELECT a AS src, b AS dst FROM met WHERE cnt >= 50)", _ends("often"),
        _components("ends", "often"), recursive=True,
    ) + "SELECT label AS cluster_id, v AS activity FROM comp",
    "scc_fine": _with(TIED, REACH, recursive=True) + STRONG,
    "scc_parts": _with(PARTS_TIED, REACH, recursive=True) + STRONG,
    "lpa_fine": _with(TIED, _votes("nodes", "tied", 10)) + "SELECT label AS cluster_id, v AS activity FROM lpa",
    "min_label_fine": _with(TIED, _min_label("nodes", "tied")) + "SELECT label AS cluster_id, v AS activity FROM minl",
    "greedy_merge_parts": _greedy(BY_ORDER, "by_order", 4),
    "score_written": ORACLES["score_all"],
    "written_scores": _with(*SCORING, COMMON, CHAIN, CONFUSION, f"ranked AS ({RANKED})", recursive=True)
    + """SELECT r.*, coalesce(e.edges, 0) AS edges FROM ranked r LEFT JOIN (SELECT name, count(*) AS edges FROM predicted GROUP BY name) e
ON e.name = r.name""",
    "rejected_results": _with(LOG, NODES) + """SELECT 'runs/spoiled' AS name, 'line without a colon' AS reason, activity AS value FROM nodes
UNION ALL SELECT 'runs/spoiled', 'no cluster in the file', NULL UNION ALL SELECT 'transitions', 'not a text file', NULL""",
    "csv_log": _with(LOG)
    + "SELECT row_number() OVER (ORDER BY ts, event_id) AS row_number, case_id, date_trunc('second', ts) AS ts, activity, cluster FROM log",
    "written_thresholds": ORACLES["threshold_clusters_nested"],
    "written_counts": ORACLES["component_count_sweep"],
    "written_groups": ORACLES["flow_groups"],
    "written_csv": _with(COMPONENTS, recursive=True) + 'SELECT label AS "ClusterID", v AS "Activity" FROM comp',
}
