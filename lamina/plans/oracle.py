"""The queries' results by other methods, in SQL: theta joins for array predicates, islands of the path for scanned states, walks to the end for backward layers."""

_TIES = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"
_LINES = f"""
    lines AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, {_TIES}) - 1 AS pos,
                     row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, {_TIES}) - 1 AS bridge,
                     count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
    path AS (SELECT l_orderkey, n, pos + 1 AS k, bridge AS p FROM lines
             UNION ALL SELECT DISTINCT l_orderkey, n, 0, n + 1 FROM lines UNION ALL SELECT DISTINCT l_orderkey, n, n + 1, n FROM lines),
    arcs AS (SELECT * FROM (SELECT l_orderkey, n, k, p AS a, lead(p) OVER (PARTITION BY l_orderkey ORDER BY k) AS b FROM path) WHERE b IS NOT NULL)"""
_CLASH = "((x.a > least(y.a, y.b) AND x.a < greatest(y.a, y.b)) <> (x.b > least(y.a, y.b) AND x.b < greatest(y.a, y.b)))"
_PAIRS = f"pairs AS (SELECT x.l_orderkey, x.n, x.k AS k1, y.k AS k2 FROM arcs x JOIN arcs y ON x.l_orderkey = y.l_orderkey AND x.k < y.k AND x.k % 2 = y.k % 2 AND {_CLASH})"
_ORDERS = "orders_ AS (SELECT l_orderkey, any_value(n) AS n, string_agg(bridge::VARCHAR, ',' ORDER BY pos) AS perm FROM lines GROUP BY l_orderkey)"
_GOOD = "good AS (SELECT l_orderkey, n FROM orders_ WHERE l_orderkey NOT IN (SELECT l_orderkey FROM pairs))"
# Open arcs after k bridges: both ends of each run of the path over bridges below k; from the outermost above to the outermost below.
_STATES = """
    ks AS (SELECT l_orderkey, n, unnest(range(0, n + 1)) AS cut FROM good),
    pts AS (SELECT ks.l_orderkey, ks.n, cut, k, p FROM ks JOIN path USING (l_orderkey) WHERE p < cut),
    isl AS (SELECT *, k - row_number() OVER (PARTITION BY l_orderkey, cut ORDER BY k) AS g FROM pts),
    runs AS (SELECT l_orderkey, n, cut, g, min(k) AS k0, max(k) AS k1, arg_min(p, k) AS p0, arg_max(p, k) AS p1 FROM isl GROUP BY ALL),
    ends AS (SELECT l_orderkey, n, cut, g, p0 AS p, (k0 - 1) % 2 AS up FROM runs UNION ALL SELECT l_orderkey, n, cut, g, p1, k1 % 2 FROM runs),
    seen AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, cut ORDER BY up DESC, CASE WHEN up = 1 THEN p ELSE -p END) AS place FROM ends),
    lett AS (SELECT *, CASE WHEN place = min(place) OVER (PARTITION BY l_orderkey, cut, g) THEN '(' ELSE ')' END AS c FROM seen),
    stat AS (SELECT ks.l_orderkey, ks.n, ks.cut AS k, coalesce(string_agg(c, '' ORDER BY place), '') AS word, coalesce(sum(up), 0)::INT AS h FROM ks LEFT JOIN lett USING (l_orderkey, cut) GROUP BY ks.l_orderkey, ks.n, ks.cut),
    layer AS (SELECT n, k, word, h, count(*) AS orders FROM stat GROUP BY ALL)"""
# The piece that each letter of w ends: brackets of one depth, in order, are its two ends by twos; E has a piece to itself.
_DEPTH = "(len(replace(w[:{i}], ')', '')) - len(replace(w[:{i}], '(', '')) - (w[{i}] = '(')::INT)"
_PIECES = f"""list_transform(range(1, len(w) + 1), lambda i: CASE WHEN w[i] = 'E' THEN -1 ELSE 1000 * {_DEPTH.format(i="i")}
              + len(list_filter(range(1, i + 1), lambda j: w[j] = '(' AND {_DEPTH.format(i="j")} = {_DEPTH.format(i="i")})) END)"""
#: What a point does above and below: opens an arc there (1), closes the one at the cut (0), or has none (null), as the east end has on one side.
_DEEDS = "(VALUES (false, 1, 1), (false, 1, 0), (false, 0, 1), (false, 0, 0), (true, 1, 1), (true, 0, 0)) AS deed(last, up, dn)"


def _moves(rows: str) -> str:
    """All moves of point x from rows (n, x, w, h, ...): the rows with up, dn, nw, nh.

    One rule for all points: the letters that stay are listed by their pieces, the point's piece
    being 0; pieces whose ends the point takes become piece 0 as well. A piece with two ends in the
    list is a pair of brackets, one with a single end leads east. A point that takes both ends of
    one piece, or the single end of one when it is the last, would close the curve.
    """
    letter = "CASE WHEN len(list_filter(ends, lambda e: e = ends[i])) = 1 THEN 'E' WHEN list_position(ends, ends[i]) = i THEN '(' ELSE ')' END"
    return f"""
        SELECT * EXCLUDE (q, last, above, below, taken, ends), array_to_string(list_transform(range(1, len(ends) + 1), lambda i: {letter}), '') AS nw, len(above) AS nh FROM (
        SELECT *, list_transform(list_concat(above, below), lambda e: CASE WHEN list_contains(taken, e) THEN 0 ELSE e END) AS ends FROM (
        SELECT *, CASE up WHEN 1 THEN list_append(q[:h], 0) WHEN 0 THEN q[:h - 1] ELSE q[:h] END AS above,
                  CASE dn WHEN 1 THEN list_prepend(0, q[h + 1:]) WHEN 0 THEN q[h + 2:] ELSE q[h + 1:] END AS below,
                  list_concat(CASE WHEN up = 0 THEN q[h:h] ELSE [] END, CASE WHEN dn = 0 THEN q[h + 1:h + 1] ELSE [] END) AS taken FROM (
        SELECT r.* EXCLUDE (q), q, deed.last, CASE WHEN deed.last AND n % 2 = 0 THEN NULL ELSE deed.up END AS up, CASE WHEN deed.last AND n % 2 = 1 THEN NULL ELSE deed.dn END AS dn
            FROM (SELECT *, {_PIECES} AS q FROM {rows}) r JOIN {_DEEDS} ON deed.last = (x = n)))
        WHERE len(taken) = coalesce((up = 0)::INT, 0) + coalesce((dn = 0)::INT, 0) AND len(list_distinct(taken)) = len(taken) AND NOT (last AND list_contains(taken, -1)))"""


# Every open arc has to be closed by a later point with an arc on its side, but the one of the curve's start, below.
_VIABLE = "nh <= len(list_filter(range(x + 1, n + 1), lambda t: t < n OR n % 2 = 1)) AND len(nw) - nh <= 1 + len(list_filter(range(x + 1, n + 1), lambda t: t < n OR n % 2 = 0))"
#: The brackets of a word as binary digits behind a leading 1.
_BITS = "list_reduce(list_prepend(1::BIGINT, list_transform(string_split(replace({w}, 'E', ''), ''), lambda c: CASE c WHEN '(' THEN 0 WHEN ')' THEN 1 END::BIGINT)), lambda s, d: CASE WHEN d IS NULL THEN s ELSE 2 * s + d END)"
_HALF = "half AS (SELECT n, k AS x, word AS w, h, orders FROM layer WHERE k = n // 2)"

_BACK = f"""
        words(w) AS (SELECT '' UNION SELECT w[:i] || '()' || w[i + 1:] FROM words, range(0, len(w) + 1) r(i) WHERE len(w) <= (SELECT max(len(w)) FROM half)),
        cand AS (SELECT 1000000 AS n, 0 AS x, w, h::INT AS h FROM words, range(0, len(w) + 1) r(h)),
        back AS (SELECT w, h, nw, nh, len(w) - (len(replace(w[:h], ')', '')) - len(replace(w[:h], '(', ''))) AS depth FROM ({_moves('cand')}))"""

# All orders' own actions, walked one by one; an order whose action is not among the moves has no further row.
_RUNS = f"""
        acts AS (SELECT p.l_orderkey, p.p AS x, max(CASE WHEN s.k % 2 = 1 THEN (s.q > p.p)::INT END) AS up, max(CASE WHEN s.k % 2 = 0 THEN (s.q > p.p)::INT END) AS dn
                 FROM path p JOIN (SELECT l_orderkey, k, a AS p, b AS q FROM arcs UNION ALL SELECT l_orderkey, k, b, a FROM arcs) s ON s.l_orderkey = p.l_orderkey AND s.p = p.p WHERE p.p < p.n GROUP BY p.l_orderkey, p.p),
        walk AS (SELECT DISTINCT l_orderkey, n, 0::BIGINT AS x, '' AS w, 0::BIGINT AS h FROM lines
                 UNION ALL SELECT m.l_orderkey, n, m.x + 1, nw, nh FROM ({_moves('walk')}) m JOIN acts ON acts.l_orderkey = m.l_orderkey AND acts.x = m.x AND acts.up = m.up AND acts.dn = m.dn WHERE m.x < n)"""
_COULD_END = "CASE WHEN x = 0 THEN w = '' ELSE w = '()' AND h = x % 2 END"
# A search by whole paths: the arc from the path's last point to b crosses no arc of its side; after it every arc has an even number of ends to come inside.
_INSIDE = "({x} > least(path[j], path[j + 1]) AND {x} < greatest(path[j], path[j + 1]))"
_REACH = f"len(list_filter(range(1, len(path)), lambda j: (len(path) - j) % 2 = 0 AND {_INSIDE.format(x='path[len(path)]')} <> {_INSIDE.format(x='{b}')})) = 0"
_EVEN = f"""len(list_filter(range(1, len(path)), lambda j: (len(list_filter(range(0, n), lambda u: NOT list_contains(path, u) AND {_INSIDE.format(x="u")}))
            + ((len(path) - j) % 2 = 0 AND {_INSIDE.format(x="path[len(path)]")})::INT + ((n - j) % 2 = 1 AND {_INSIDE.format(x="n")})::INT) % 2 = 1)) = 0"""
_SEARCH = f"""
        begun AS (SELECT n, prefix, count(*) AS orders FROM (SELECT g.l_orderkey, g.n, list(bridge ORDER BY pos)[:g.n // 2] AS prefix FROM good g JOIN lines l ON l.l_orderkey = g.l_orderkey GROUP BY g.l_orderkey, g.n) GROUP BY ALL),
        walk AS (SELECT n, prefix, list_prepend(n + 1, prefix) AS path FROM begun
                 UNION ALL SELECT * FROM (SELECT n, prefix, list_append(path, b) AS path FROM walk, range(0, 64) r(b) WHERE b < n AND NOT list_contains(path, b) AND {_REACH.format(b="b")}) WHERE {_EVEN})"""

SQL = {
    "order_crossings": f"WITH {_LINES}, {_PAIRS}, {_ORDERS} SELECT l_orderkey, n, perm, coalesce(c, 0) AS crossings, c IS NULL AS is_simple FROM orders_ LEFT JOIN (SELECT l_orderkey, count(*) AS c FROM pairs GROUP BY 1) USING (l_orderkey)",
    "order_arc_join": f"WITH {_LINES}, {_PAIRS} SELECT l_orderkey, k1 % 2 AS side, count(*) AS crossings FROM pairs GROUP BY ALL",
    "closed_orders": f"""
        WITH {_LINES}, pts AS (SELECT l_orderkey, n, pos + 1 AS k, n - bridge AS p FROM lines WHERE n % 2 = 1 UNION ALL SELECT DISTINCT l_orderkey, n, 0, 0 FROM lines WHERE n % 2 = 1),
        loop AS (SELECT l_orderkey, k, p AS a, coalesce(lead(p) OVER w, first_value(p) OVER w) AS b FROM pts WINDOW w AS (PARTITION BY l_orderkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
        c AS (SELECT x.l_orderkey, count(*) AS c FROM loop x JOIN loop y ON x.l_orderkey = y.l_orderkey AND x.k < y.k AND x.k % 2 = y.k % 2 AND {_CLASH} GROUP BY 1)
        SELECT l_orderkey, string_agg(p::VARCHAR, ',' ORDER BY k) AS closed, coalesce(any_value(c), 0) AS crossings, any_value(c) IS NULL AS is_closed FROM pts LEFT JOIN c USING (l_orderkey) GROUP BY l_orderkey""",
    "order_search_depth": f"""
        WITH {_LINES}, {_PAIRS}, {_ORDERS},
        clear AS (SELECT l_orderkey, min(k2) AS t FROM pairs WHERE k2 < n GROUP BY 1),
        odd AS (SELECT t.l_orderkey, t.n, t.k AS t, a.k, (SELECT count(*) FROM path u WHERE u.l_orderkey = a.l_orderkey AND u.k > t.k + 1 AND u.k <= u.n AND u.p > least(a.a, a.b) AND u.p < greatest(a.a, a.b))
                       + (CASE WHEN (t.k + 1) % 2 = a.k % 2 AND t.b > least(a.a, a.b) AND t.b < greatest(a.a, a.b) THEN 1 ELSE 0 END)
                       + (CASE WHEN a.n % 2 = a.k % 2 AND a.n > least(a.a, a.b) AND a.n < greatest(a.a, a.b) THEN 1 ELSE 0 END) AS c
                FROM arcs t JOIN arcs a ON a.l_orderkey = t.l_orderkey AND a.k <= t.k WHERE t.k < t.n - 1),
        dead AS (SELECT l_orderkey, min(t) AS t FROM odd WHERE c % 2 = 1 GROUP BY 1)
        SELECT o.l_orderkey, o.n, coalesce(c.t, o.n) AS clear, least(coalesce(c.t, o.n), coalesce(d.t, o.n)) AS clear_and_open
        FROM orders_ o LEFT JOIN clear c USING (l_orderkey) LEFT JOIN dead d USING (l_orderkey)""",
    "order_sides": f"""
        WITH {_LINES}, {_PAIRS}, {_ORDERS}, {_GOOD},
        ends AS (SELECT l_orderkey, k % 2 AS up, a AS p, b > a AS opens FROM arcs UNION ALL SELECT l_orderkey, k % 2, b, a > b FROM arcs),
        sides AS (SELECT e.l_orderkey, g.n, string_agg(CASE WHEN opens THEN 'U' ELSE 'D' END, '' ORDER BY p) FILTER (up = 1) AS above, string_agg(CASE WHEN opens THEN 'U' ELSE 'D' END, '' ORDER BY p) FILTER (up = 0) AS below
                  FROM ends e JOIN good g USING (l_orderkey) WHERE p < g.n GROUP BY ALL)
        SELECT n, above, below, count(*) AS orders FROM sides GROUP BY ALL""",
    "order_layers": f"WITH {_LINES}, {_PAIRS}, {_ORDERS}, {_GOOD}, {_STATES} SELECT n, k, word, h::BIGINT AS h, orders FROM layer",
    "layer_successors": f"""
        WITH {_LINES}, {_PAIRS}, {_ORDERS}, {_GOOD}, {_STATES}, {_HALF}, moved AS ({_moves('half')})
        SELECT n, x + 1 AS k, nw AS word, nh::BIGINT AS h, sum(orders)::BIGINT AS orders FROM moved WHERE {_VIABLE} GROUP BY ALL""",
    "layer_predecessors": f"""
        WITH RECURSIVE {_LINES}, {_PAIRS}, {_ORDERS}, {_GOOD}, {_STATES}, {_HALF}, {_BACK}
        SELECT half.n, half.x AS k, back.w AS word, back.h::BIGINT AS h, depth::BIGINT AS depth, sum(orders)::BIGINT AS orders
        FROM half JOIN back ON nw = half.w AND nh = half.h WHERE half.x > 0 AND depth < half.x GROUP BY ALL""",
    "meet_in_the_middle": f"""
        WITH RECURSIVE {_LINES}, {_PAIRS}, {_ORDERS}, {_GOOD}, {_STATES}, {_HALF},
        walk AS (SELECT n, x AS k, x, w, h, orders FROM half
                 UNION ALL SELECT n, k, x + 1, nw, nh, sum(orders) FROM (SELECT * FROM ({_moves('walk')}) WHERE {_VIABLE}) GROUP BY n, k, x, nw, nh)
        SELECT n, k, (SELECT sum(orders)::BIGINT FROM half WHERE half.n = walk.n) AS orders, sum(orders)::BIGINT AS ways FROM walk WHERE x = n + 1 AND w = 'E' AND h = 0 GROUP BY n, k""",
    "part_layer_merge": "SELECT l_returnflag, count(*) AS states, max(c)::BIGINT AS peak, sum(c)::BIGINT AS total FROM (SELECT l_returnflag, l_partkey, sum(l_quantity::BIGINT) AS c FROM lineitem GROUP BY ALL) GROUP BY ALL",
    "layer_dot": """
        WITH r AS (SELECT s_nationkey, l_partkey, sum(l_quantity::BIGINT) FILTER (l_returnflag = 'R') AS f, sum(l_quantity::BIGINT) FILTER (l_returnflag <> 'R') AS g
                   FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)
        SELECT s_nationkey, sum(f * g)::BIGINT AS dot FROM r WHERE f IS NOT NULL AND g IS NOT NULL GROUP BY ALL""",
    "modular_totals": """
        WITH v AS (SELECT l_partkey, round(l_extendedprice * 100)::HUGEINT * round(l_extendedprice * 100)::HUGEINT * l_quantity::HUGEINT AS v FROM lineitem)
        SELECT l_partkey, (sum(v)::HUGEINT % 2305843009213693951::HUGEINT)::BIGINT AS mod_m61, sum(v)::HUGEINT::VARCHAR AS total FROM v GROUP BY ALL""",
    "growth_ratios": """
        WITH s AS (SELECT row_number() OVER w AS n, (sum(c) OVER w)::BIGINT AS count FROM (SELECT date_trunc('month', o_orderdate) AS m, count(*) AS c FROM orders GROUP BY 1) WINDOW w AS (ORDER BY m)),
        r AS (SELECT *, count::DOUBLE / lag(count, 2) OVER (ORDER BY n) AS ratio, -ln((lead(count) OVER (ORDER BY n))::DOUBLE / (12.262874::DOUBLE * count)) / ln(1 + 1 / n::DOUBLE) AS exponent FROM s)
        SELECT n, count, round(ratio, 6) AS ratio, round(sqrt(ratio), 6) AS rate, round(exponent, 6) AS exponent, round((n * exponent - (n - 2) * lag(exponent, 2) OVER (ORDER BY n)) / 2, 6) AS extrapolated FROM r""",
    "value_report": """
        SELECT l_orderkey, c AS count, e AS expected, CASE WHEN c = e THEN 'ok' ELSE 'MISMATCH(' || e || ')' END AS verdict
        FROM (SELECT o_orderkey AS l_orderkey, count(l_orderkey) AS c, coalesce(max(l_linenumber), 0)::BIGINT AS e FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)""",
    "two_split_check": """
        SELECT l_orderkey, count(*) AS count, count(DISTINCT l_linenumber) AS "check", CASE WHEN count(*) = count(DISTINCT l_linenumber) THEN 'ok' ELSE 'MISMATCH(' || count(DISTINCT l_linenumber) || ')' END AS verdict
        FROM lineitem GROUP BY 1""",
    "segment_union": """
        SELECT event_type, depth, CASE WHEN depth <= 10 THEN 0 WHEN depth <= 30 THEN 1 ELSE 2 END::BIGINT AS seg, count(*) AS events
        FROM (SELECT event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS depth FROM events) GROUP BY ALL""",
    "numbered_orders": f"""
        WITH {_LINES}, o AS (SELECT l_orderkey, any_value(n) AS n, list(bridge ORDER BY pos) AS perm FROM lines GROUP BY 1),
        k AS (SELECT n, perm, count(*) AS orders FROM o GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY perm) AS number FROM k)
        SELECT n, array_to_string(perm, ',') AS perm, orders, number, number % 10 = 1 AS sampled FROM r""",
    "order_bounds": f"""
        WITH {_LINES}, {_PAIRS}, {_ORDERS}, {_GOOD},
        t AS (SELECT n, count(*) AS orders, count(DISTINCT perm) AS kinds, count(DISTINCT perm) FILTER (l_orderkey IN (SELECT l_orderkey FROM good)) AS simple FROM orders_ GROUP BY n),
        c AS (SELECT *, factorial(n::INT)::BIGINT AS most, CASE WHEN n % 2 = 1 THEN power(factorial((n + 1)::INT)::DOUBLE / factorial(((n + 1) // 2)::INT) / factorial(((n + 3) // 2)::INT), 2)::BIGINT END AS most_simple FROM t)
        SELECT *, kinds <= most AND (n % 2 = 0 OR simple <= most_simple) AS keeps FROM c""",
    "event_interleavings": """
        WITH e AS (SELECT user_id, k, least(a, b) AS l, greatest(a, b) AS r FROM (SELECT user_id, row_number() OVER w AS k, value AS a, lead(value) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE b IS NOT NULL)
        SELECT x.user_id, count(*) AS interleavings FROM e x JOIN e y ON x.user_id = y.user_id AND (x.k - y.k) % 2 = 0 AND x.l < y.l AND y.l < x.r AND x.r < y.r GROUP BY 1""",
    "packed_successors": f"""
        WITH {_LINES}, {_PAIRS}, {_ORDERS}, {_GOOD}, {_STATES}, {_HALF}, moved AS ({_moves('half')}),
        grown AS (SELECT n, x, nw, nh, sum(orders)::BIGINT AS orders, any_value({_VIABLE}) AS open FROM moved WHERE x < n GROUP BY n, x, nw, nh)
        SELECT n, x + 1 AS k, nh::BIGINT AS h, instr(nw, 'E')::BIGINT - 1 AS e, {_BITS.format(w="nw")} AS bits, nw AS word, open, orders FROM grown""",
    "packed_predecessors": f"""
        WITH RECURSIVE {_LINES}, {_PAIRS}, {_ORDERS}, {_GOOD}, {_STATES}, {_HALF}, {_BACK}
        SELECT half.n, half.x AS k, CASE WHEN depth <= 1 THEN 0 WHEN depth <= 2 THEN 1 ELSE 2 END::BIGINT AS seg, back.h::BIGINT AS h, {_BITS.format(w="back.w")} AS bits, depth::BIGINT AS depth, sum(orders)::BIGINT AS orders
        FROM half JOIN back ON nw = half.w AND nh = half.h WHERE half.x > 0 AND depth < half.x GROUP BY ALL""",
    "finished_orders": f"""
        WITH {_LINES}, {_PAIRS}, {_ORDERS}, {_GOOD}, {_STATES}
        SELECT n, (SELECT count(*) FROM layer l WHERE l.n = g.n AND l.k = g.n) AS states, count(DISTINCT perm) AS runs, count(*) AS accepted FROM good g JOIN orders_ USING (l_orderkey, n) GROUP BY n""",
    "decoded_orders": f"""
        WITH {_LINES}, {_PAIRS}, {_ORDERS}, {_GOOD}
        SELECT o.l_orderkey, CASE WHEN g.n IS NOT NULL THEN perm END AS decoded, g.n IS NOT NULL AS same FROM orders_ o LEFT JOIN good g USING (l_orderkey)""",
    "closed_open_sets": f"""
        WITH {_LINES}, {_PAIRS}, {_ORDERS}, {_GOOD},
        pts AS (SELECT l_orderkey, n, pos + 1 AS k, n - bridge AS p FROM lines WHERE n % 2 = 1 UNION ALL SELECT DISTINCT l_orderkey, n, 0, 0 FROM lines WHERE n % 2 = 1),
        loop AS (SELECT l_orderkey, k, p AS a, coalesce(lead(p) OVER w, first_value(p) OVER w) AS b FROM pts WINDOW w AS (PARTITION BY l_orderkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
        bad AS (SELECT DISTINCT x.l_orderkey FROM loop x JOIN loop y ON x.l_orderkey = y.l_orderkey AND x.k < y.k AND x.k % 2 = y.k % 2 AND {_CLASH}),
        shut AS (SELECT l_orderkey, any_value(n) AS n, string_agg(p::VARCHAR, ',' ORDER BY k) AS closed FROM pts GROUP BY 1),
        c AS (SELECT DISTINCT n, closed FROM shut WHERE l_orderkey NOT IN (SELECT l_orderkey FROM bad)),
        i AS (SELECT DISTINCT n, closed FROM shut WHERE l_orderkey IN (SELECT l_orderkey FROM good)),
        k AS (SELECT n FROM c UNION SELECT n FROM i)
        SELECT (n + 1) // 2 AS n, (SELECT count(DISTINCT perm) FROM orders_ o WHERE o.n = k.n AND l_orderkey IN (SELECT l_orderkey FROM good)) AS open_kinds, (SELECT count(*) FROM c WHERE c.n = k.n) AS closed_kinds,
               (SELECT count(*) FROM (SELECT * FROM i EXCEPT SELECT * FROM c) z WHERE z.n = k.n) AS only_open, (SELECT count(*) FROM (SELECT * FROM c EXCEPT SELECT * FROM i) z WHERE z.n = k.n) AS only_closed FROM k""",
    "inverse_steps": f"""
        WITH RECURSIVE {_LINES}, {_PAIRS}, {_ORDERS}, {_GOOD}, {_STATES}, {_HALF}, late AS (SELECT n, k - 1 AS x, word AS w, h FROM layer WHERE k = n // 2 + 1 AND k <= n),
        forth AS (SELECT DISTINCT m.n, m.x, m.w, m.h, m.nw, m.nh FROM ({_moves('half')}) m JOIN late l ON l.n = m.n AND l.x = m.x AND l.w = m.nw AND l.h = m.nh WHERE m.x < m.n),
        {_BACK},
        rear AS (SELECT DISTINCT l.n, l.x, b.w, b.h, b.nw, b.nh FROM late l JOIN back b ON b.nw = l.w AND b.nh = l.h JOIN half e ON e.n = l.n AND e.x = l.x AND e.w = b.w AND e.h = b.h),
        met AS (SELECT n, x, f.w IS NOT NULL AS f, r.w IS NOT NULL AS r FROM forth f FULL JOIN rear r USING (n, x, w, h, nw, nh))
        SELECT n, x AS k, count(*) FILTER (f) AS forward, count(*) FILTER (r) AS backward, count(*) FILTER (f AND NOT r) AS only_forward, count(*) FILTER (r AND NOT f) AS only_backward FROM met GROUP BY n, x""",
    "value_files": f"""
        WITH {_LINES}, {_PAIRS}, {_ORDERS}, {_GOOD}
        SELECT o.n, count(*) AS orders, count(g.n) AS simple, CASE WHEN count(*) = count(DISTINCT o.l_orderkey) THEN 'ok' ELSE 'MISMATCH(' || count(DISTINCT o.l_orderkey) || ')' END AS verdict FROM orders_ o LEFT JOIN good g USING (l_orderkey) GROUP BY o.n""",
    "state_split_check": f"""
        WITH RECURSIVE {_LINES}, {_PAIRS}, {_ORDERS}, {_GOOD}, {_STATES}, {_HALF},
        later AS (SELECT n, x + 1 AS x, nw AS w, nh AS h, sum(orders) AS orders FROM ({_moves('half')}) WHERE x < n GROUP BY n, x, nw, nh),
        walk AS (SELECT n, 0 AS split, x, w, h, orders::HUGEINT AS orders FROM half UNION ALL SELECT n, 1, x, w, h, orders FROM later
                 UNION ALL SELECT n, split, x + 1, nw, nh, sum(orders) FROM (SELECT * FROM ({_moves('walk')}) WHERE {_VIABLE}) GROUP BY n, split, x, nw, nh),
        done AS (SELECT n, split, sum(orders)::BIGINT AS ways FROM walk WHERE x = n + 1 AND w = 'E' AND h = 0 GROUP BY n, split)
        SELECT n, coalesce(a.ways, 0) AS count, coalesce(b.ways, 0) AS "check", CASE WHEN coalesce(a.ways, 0) = coalesce(b.ways, 0) THEN 'ok' ELSE 'MISMATCH(' || coalesce(b.ways, 0) || ')' END AS verdict
        FROM (SELECT DISTINCT n FROM half) LEFT JOIN (SELECT * FROM done WHERE split = 0) a USING (n) LEFT JOIN (SELECT * FROM done WHERE split = 1) b USING (n)""",
    "accepted_runs": f"""
        WITH RECURSIVE {_LINES}, {_RUNS}
        SELECT n, event, k, count(*) AS orders FROM (
            SELECT n, x AS k, CASE WHEN {_COULD_END} THEN 'accepted' ELSE 'unfinished' END AS event FROM walk WHERE x = n
            UNION ALL SELECT n, x AS k, 'refused' FROM walk w WHERE x < n AND NOT EXISTS (SELECT 1 FROM walk v WHERE v.l_orderkey = w.l_orderkey AND v.x = w.x + 1)) GROUP BY ALL""",
    "finishing_counts": f"""
        WITH RECURSIVE {_LINES}, {_RUNS} SELECT x AS k, count(*) AS passed, count(*) FILTER ({_COULD_END}) AS could_end FROM walk GROUP BY x""",
    "prefix_completions": f"""
        WITH RECURSIVE {_LINES}, {_PAIRS}, {_ORDERS}, {_GOOD}, {_SEARCH}
        SELECT n, array_to_string(prefix, ',') AS prefix, orders, coalesce(c, 0) AS completions FROM begun LEFT JOIN (SELECT n, prefix, count(*) AS c FROM walk WHERE len(path) = n + 1 AND {_REACH.format(b="n")} GROUP BY n, prefix) USING (n, prefix)""",
    "search_nodes": f"""
        WITH RECURSIVE {_LINES}, {_PAIRS}, {_ORDERS}, {_GOOD}, {_SEARCH} SELECT n, len(path) - 1 AS used, count(*) AS nodes FROM walk GROUP BY ALL""",
    "decorated_states": f"""
        WITH {_LINES}, {_PAIRS}, {_ORDERS}, {_GOOD}, {_STATES},
        part AS (SELECT l_orderkey, cut, g, string_agg(p::VARCHAR, ',' ORDER BY k) AS forth, string_agg(p::VARCHAR, ',' ORDER BY k DESC) AS rear, min(k) AS k0, arg_min(p, k) AS p0 FROM isl GROUP BY ALL),
        sided AS (SELECT l_orderkey, n, cut, g, p0 AS p, (k0 - 1) % 2 AS up, true AS first FROM runs UNION ALL SELECT l_orderkey, n, cut, g, p1, k1 % 2, false FROM runs),
        spelt AS (SELECT s.*, CASE WHEN first THEN forth ELSE rear END AS strand FROM sided s JOIN part USING (l_orderkey, cut, g)),
        text_ AS (SELECT l_orderkey, cut AS k, string_agg(strand, '|' ORDER BY up DESC, CASE WHEN up = 1 THEN p ELSE -p END) AS pieces FROM spelt GROUP BY ALL)
        SELECT s.n, s.k, word, h::BIGINT AS h, coalesce(pieces, '') AS pieces, CASE WHEN s.k = s.n THEN perm END AS whole, count(*) AS orders
        FROM stat s JOIN orders_ o USING (l_orderkey) LEFT JOIN text_ t USING (l_orderkey, k) GROUP BY ALL""",
    "numbered_states": f"""
        WITH {_LINES}, {_PAIRS}, {_ORDERS}, {_GOOD}, {_STATES},
        mates AS (SELECT a.l_orderkey, a.n, a.cut AS k, a.place, a.up, CASE WHEN b.up = 1 THEN 2 * (b.place - 1) + 2 ELSE 2 * (t.len - b.place) + 1 END AS code
                  FROM seen a JOIN seen b ON a.l_orderkey = b.l_orderkey AND a.cut = b.cut AND a.g = b.g AND a.place <> b.place JOIN (SELECT l_orderkey, cut, max(place) AS len FROM seen GROUP BY ALL) t ON t.l_orderkey = a.l_orderkey AND t.cut = a.cut),
        key_ AS (SELECT l_orderkey, k, list(code ORDER BY up DESC, CASE WHEN up = 1 THEN place ELSE -place END) AS code FROM mates GROUP BY ALL),
        kinds AS (SELECT n, k, word, h, coalesce(code, []) AS code, count(*) AS orders FROM stat LEFT JOIN key_ USING (l_orderkey, k) GROUP BY ALL)
        SELECT n, k, word, h::BIGINT AS h, array_to_string(code, ',') AS code, row_number() OVER (PARTITION BY n, k ORDER BY h, code) AS number, orders FROM kinds""",
    "extended_predecessors": f"""
        WITH RECURSIVE {_LINES}, {_PAIRS}, {_ORDERS}, {_GOOD}, {_STATES}, {_HALF}, {_BACK}
        SELECT half.n, half.x AS k, CASE WHEN depth <= 2 THEN 0 WHEN depth <= 4 THEN 1 ELSE 2 END::BIGINT AS seg, back.h::BIGINT AS h, {_BITS.format(w="back.w")} AS bits, depth::BIGINT AS depth, sum(orders)::BIGINT AS orders
        FROM half JOIN back ON nw = half.w AND nh = half.h WHERE half.x > 0 GROUP BY ALL""",
    "bucketed_dots": """
        WITH q AS (SELECT l_partkey, l_returnflag AS flag, sum(l_quantity::BIGINT) AS c FROM lineitem GROUP BY ALL),
        f AS (SELECT * FROM (VALUES ('A', 'N'), ('A', 'R'), ('N', 'R')) v(flag, other))
        SELECT f.flag, f.other, coalesce(sum(x.c * y.c), 0)::BIGINT AS dot FROM f LEFT JOIN q x ON x.flag = f.flag LEFT JOIN q y ON y.flag = f.other AND y.l_partkey = x.l_partkey GROUP BY ALL""",
    "residue_layers": """
        WITH v AS (SELECT l_returnflag, round(l_extendedprice * 100)::HUGEINT AS c, l_quantity::HUGEINT AS q FROM lineitem),
        p AS (SELECT l_returnflag, sum((q * c * c * c * c * c) // 1000000000000000000)::HUGEINT AS hi, sum((q * c * c * c * c * c) % 1000000000000000000)::HUGEINT AS lo FROM v GROUP BY 1)
        SELECT l_returnflag, (hi + lo // 1000000000000000000)::VARCHAR || lpad((lo % 1000000000000000000)::VARCHAR, 18, '0') AS total FROM p""",
}
