"""Reference SQL of the clustering, by brute force over all pairs of a group."""

from __future__ import annotations

FEATURES = {
    "size": ["h", "w", "d"],
    "shape": ["h / (w + 1e-6)", "w / (d + 1e-6)", "h / (d + 1e-6)"],
    "volume": ["h * w * d"],
}


def points(source: str, group: str, settings=("size", "shape", "volume"), positive: bool = True,
           order: str = "product_id") -> str:
    """CTEs up to nb(g, a, b, d2): all pairs of a group with their squared distance."""
    features = [f for s in settings for f in FEATURES[s]]
    names = [f"f{i}" for i in range(len(features))]
    where = "WHERE height > 0 AND width > 0 AND depth > 0" if positive else \
        "WHERE height IS NOT NULL AND width IS NOT NULL AND depth IS NOT NULL"
    raw = ", ".join(f"{f} AS {n}" for f, n in zip(features, names, strict=True))
    z = ", ".join(f"(r.{n} - m.a{n}) / CASE WHEN m.s{n} = 0 THEN 1 ELSE m.s{n} END AS {n}" for n in names)
    moments = ", ".join(f"avg({n}) AS a{n}, stddev_pop({n}) AS s{n}" for n in names)
    d2 = " + ".join(f"(x.{n} - y.{n}) * (x.{n} - y.{n})" for n in names)
    return f"""src AS (SELECT {group} AS g, {order} AS id, height AS h, width AS w, depth AS d FROM ({source}) s {where}),
raw AS (SELECT g, id, {raw} FROM src), mom AS (SELECT g, {moments} FROM raw GROUP BY g),
z AS MATERIALIZED (SELECT r.g, r.id, {z} FROM raw r JOIN mom m ON r.g = m.g),
nb AS MATERIALIZED (SELECT x.g, x.id AS a, y.id AS b, {d2} AS d2 FROM z x JOIN z y ON x.g = y.g)"""


def noise(eps: float = 1.0, min_samples: int = 4) -> str:
    """CTE noise(g, id, noise) without recursion: neither core nor next to a core point."""
    return f"""near AS MATERIALIZED (SELECT g, a, b FROM nb WHERE d2 <= {eps * eps}E0),
core AS MATERIALIZED (SELECT g, a AS id FROM near GROUP BY g, a HAVING count(*) >= {min_samples}),
touched AS (SELECT DISTINCT n.g, n.a AS id FROM near n JOIN core c ON c.g = n.g AND c.id = n.b),
noise AS (SELECT z.g, z.id, t.id IS NULL AS noise FROM z LEFT JOIN touched t ON t.g = z.g AND t.id = z.id)"""


def clusters(configs: str = "SELECT 1.0E0 AS eps, 4 AS m") -> str:
    """CTE clus(g, eps, m, id, cluster); needs WITH RECURSIVE.

    Reach starts from core points without a smaller core neighbour: the first core point of a
    component is one of them.
    """
    return f"""cfg AS (SELECT g, eps, m FROM (SELECT g, count(*) AS n FROM z GROUP BY g) s CROSS JOIN ({configs}) c WHERE n >= m),
near AS MATERIALIZED (SELECT n.g, c.eps, c.m, n.a, n.b FROM nb n JOIN cfg c ON c.g = n.g AND n.d2 <= c.eps * c.eps),
core AS MATERIALIZED (SELECT g, eps, m, a AS id FROM near GROUP BY g, eps, m, a HAVING count(*) >= m),
link AS MATERIALIZED (SELECT n.* FROM near n JOIN core x ON x.g = n.g AND x.eps = n.eps AND x.m = n.m AND x.id = n.a
  JOIN core y ON y.g = n.g AND y.eps = n.eps AND y.m = n.m AND y.id = n.b),
seed AS (SELECT g, eps, m, a AS id FROM link GROUP BY g, eps, m, a HAVING min(b) = a),
reach AS (SELECT g, eps, m, id AS s, id AS t FROM seed
  UNION SELECT r.g, r.eps, r.m, r.s, l.b FROM reach r JOIN link l ON l.g = r.g AND l.eps = r.eps AND l.m = r.m AND l.a = r.t),
lab AS (SELECT g, eps, m, t AS id, min(s) AS label FROM reach GROUP BY g, eps, m, t),
num AS (SELECT g, eps, m, label, row_number() OVER (PARTITION BY g, eps, m ORDER BY label) - 1 AS n
  FROM (SELECT DISTINCT g, eps, m, label FROM lab) d),
mine AS (SELECT l.g, l.eps, l.m, l.id, n.n FROM lab l JOIN num n ON n.g = l.g AND n.eps = l.eps AND n.m = l.m AND n.label = l.label),
edge AS (SELECT e.g, e.eps, e.m, e.a AS id, min(c.n) AS n FROM near e JOIN mine c ON c.g = e.g AND c.eps = e.eps AND c.m = e.m AND c.id = e.b GROUP BY e.g, e.eps, e.m, e.a),
clus AS (SELECT z.g, cfg.eps, cfg.m, z.id, CAST(coalesce(c.n, e.n, -1) AS INT) AS cluster FROM z JOIN cfg ON cfg.g = z.g
  LEFT JOIN mine c ON c.g = z.g AND c.eps = cfg.eps AND c.m = cfg.m AND c.id = z.id
  LEFT JOIN edge e ON e.g = z.g AND e.eps = cfg.eps AND e.m = cfg.m AND e.id = z.id)"""
