"""SQL twins of greedy choices: recursive queries that take one row per group and round."""

from __future__ import annotations


def greedy(rows: str, near: str, n: int, name: str = "chosen") -> str:
    """CTE `name` (g, k, seed, s): up to `n` rows per group, best first, none near one taken before.

    `rows` names a table (g, o, s): group, rank within it, and a struct with
    the key `k`. `near` tells the row `r` from the struct `a` of a taken one.
    """
    return f"""
    {name}_rounds(g, n, taken) AS (
        SELECT g, 1, [arg_min(s, o)] FROM {rows} GROUP BY g
        UNION ALL
        SELECT t.g, n + 1, list_append(taken, arg_min(r.s, r.o)) FROM {name}_rounds t JOIN {rows} r ON t.g = r.g
        WHERE n < {n} AND len(list_filter(taken, lambda a: {near})) = 0 GROUP BY t.g, n, taken),
    {name} AS (SELECT g, taken[n].k AS k, n::BIGINT AS seed, taken[n] AS s FROM {name}_rounds)"""


def close(a: str, b: str, distance: float | str) -> str:
    """Whether two structs with x, y and z lie within `distance`."""
    squares = " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in "xyz")
    return f"sqrt({squares}) <= {distance}::DOUBLE"


def best_cluster(candidates: str, seed_near: str, member_near: str, seed_mass: str, order_mass: str | None) -> str:
    """CTEs up to `members` (g, k, score, support, secondary, worth): each group's best supported cluster.

    `candidates` names a table (g, k, score, support, secondary, s). The texts
    tell whether the structs `a` and `r.s` are near; `seed_mass` and
    `order_mass` do so for the masses.
    """
    def mass(near: str) -> str:
        return f"SELECT r.g, r.k, round(r.support + coalesce(sum(o.support) FILTER (o.k <> r.k), 0), 9) AS m FROM {candidates} r JOIN (SELECT g, k, support, s AS a FROM {candidates}) o ON o.g = r.g AND {near} GROUP BY r.g, r.k, r.support"

    tie = "c.secondary + 0.25::DOUBLE * om.m" if order_mass else "c.secondary"
    extra = f", om AS ({mass(order_mass)})" if order_mass else ""
    return f"""
    sm AS ({mass(seed_mass)}){extra},
    ordered AS (SELECT c.g, c.s, row_number() OVER (PARTITION BY c.g ORDER BY c.support DESC, sm.m DESC, {tie} DESC, c.k) AS o
                FROM {candidates} c JOIN sm USING (g, k) {"JOIN om USING (g, k)" if order_mass else ""}),
    {greedy("ordered", seed_near, 4)},
    near_seed AS (SELECT r.*, q.seed, row_number() OVER (PARTITION BY r.g, q.seed ORDER BY r.score DESC, r.k) AS r1, row_number() OVER (PARTITION BY r.g, q.seed ORDER BY r.secondary DESC, r.k) AS r2
                  FROM {candidates} r JOIN (SELECT g, seed, s AS a FROM chosen) q ON q.g = r.g AND {member_near}),
    worths AS (SELECT g, seed, round(sum(support) + 0.75 * sum(CASE WHEN r1 = 1 THEN score WHEN r1 <= 8 THEN score * 0.5 ELSE 0 END) + 0.25 * sum(CASE WHEN r2 = 1 THEN secondary WHEN r2 <= 8 THEN secondary * 0.5 ELSE 0 END), 9) AS worth FROM near_seed GROUP BY g, seed),
    winners AS (SELECT * FROM worths QUALIFY row_number() OVER (PARTITION BY g ORDER BY worth DESC, seed) = 1),
    members AS (SELECT m.g, m.k, m.s, m.score, m.support, m.secondary, w.worth FROM near_seed m JOIN winners w USING (g, seed))"""


def roles(candidates: str, shell_near: str, most_active: int, most_passive: int) -> str:
    """CTE `roles` (g, k, role), after `members`."""
    order = "score DESC, support DESC, secondary DESC, k"
    return f"""
    sums AS (SELECT g, sum(support) AS own, max(score) AS peak FROM members GROUP BY g),
    good AS (SELECT g, peak FROM sums JOIN (SELECT g, sum(support) AS every FROM {candidates} GROUP BY g) USING (g) WHERE own / every >= 0.1 OR peak >= 0.75),
    active AS (SELECT m.*, peak FROM members m JOIN good USING (g) WHERE score >= 0.75::DOUBLE * peak QUALIFY row_number() OVER (PARTITION BY g ORDER BY {order}) <= {most_active}),
    around AS (SELECT r.g, r.k FROM {candidates} r JOIN (SELECT g, k, peak, s AS a FROM active) q ON q.g = r.g AND {shell_near} GROUP BY r.g, r.k, r.score, r.support, r.secondary
               HAVING NOT bool_or(q.k = r.k) AND r.score >= 0.35::DOUBLE * max(q.peak) QUALIFY row_number() OVER (PARTITION BY r.g ORDER BY r.score DESC, r.support DESC, r.secondary DESC, r.k) <= {most_passive}),
    roles AS (SELECT g, k, 'active' AS role FROM active UNION ALL SELECT g, k, 'passive' FROM around)"""


def diverse(rows: str, gain: str, tie: str, n: int) -> str:
    """CTE `picked` (g, k, pick): each round takes the row of largest (gain, tie); all rows gain the same at first.

    `rows` names a table (g, s); `gain` is a text over r.s and `taken`, `tie` over r.s.
    """
    return f"""
    picks(g, n, taken) AS (
        SELECT g, 1, [arg_max(r.s, ({tie}))] FROM {rows} r GROUP BY g
        UNION ALL
        SELECT t.g, n + 1, list_append(taken, arg_max(r.s, ({gain}, {tie}))) FROM picks t JOIN {rows} r ON t.g = r.g
        WHERE n < {n} AND NOT list_contains(list_transform(taken, lambda a: a.k), r.s.k) GROUP BY t.g, n, taken),
    picked AS (SELECT g, taken[n].k AS k, n::BIGINT AS pick FROM picks)"""


def seen(column: str) -> str:
    """How many taken rows share the column's value."""
    return f"len(list_filter(taken, lambda a: a.{column} IS NOT DISTINCT FROM r.s.{column}))"
