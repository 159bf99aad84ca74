"""SQL text shared by the oracle queries."""

from __future__ import annotations

from collections.abc import Sequence

MR = """mr AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_suppkey % 5 AS INT) AS site,
  CAST((l_orderkey*7 + l_partkey*3 + l_linenumber) % 5 AS INT) AS fold,
  CASE WHEN l_quantity<=16 THEN 0 WHEN l_quantity<=33 THEN 1 ELSE 2 END AS snp0,
  CAST(l_partkey % 3 AS INT) AS snp1, CAST(l_linenumber % 3 AS INT) AS snp2,
  l_quantity/10e0 + 0.2e0*(l_partkey % 3) AS x, l_extendedprice/10000e0 + 0.03e0*l_quantity AS y,
  l_discount AS c1, l_tax AS u, CAST(l_returnflag = 'R' AS INT) AS yb FROM lineitem)"""

SURV = """sv AS (SELECT CAST(l_suppkey % 5 AS INT) AS site,
  CASE WHEN l_quantity<=16 THEN 0 WHEN l_quantity<=33 THEN 1 ELSE 2 END AS snp0,
  CAST(l_partkey % 3 AS INT) AS snp1, CAST(l_linenumber % 3 AS INT) AS snp2,
  l_quantity/10e0 + 0.2e0*(l_partkey % 3) AS x, l_tax AS u,
  CAST(abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) + 1 AS DOUBLE) AS time,
  CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) > 0 AS INT) AS event
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def rnd(expr: str, digits: int = 6) -> str:
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0e0)"


def s(a: str, b: str) -> str:
    a, b = sorted((a, b))
    return f"s_{a}__{b}"


def pairs(cols: Sequence[str]):
    names = sorted(set(cols))
    return [(a, b) for i, a in enumerate(names) for b in names[i:]]


def mom(name: str, cols: Sequence[str], by: Sequence[str] = ("site",), src: str = "mr") -> str:
    """Moments CTE: n, means m_*, centred cross-products s_*_*."""
    cols = sorted(set(cols))
    keys = ", ".join(by)
    items = [f"avg({c}) AS m_{c}" for c in cols]
    items += [f"covar_pop({a}, {b})*count(*) AS {s(a, b)}" for a, b in pairs(cols)]
    head = f"{keys}, " if by else ""
    tail = f" GROUP BY {keys}" if by else ""
    return f"{name} AS (SELECT {head}count(*) AS n, {', '.join(items)} FROM {src}{tail})"


def total(name: str, cols: Sequence[str], src: str, by: Sequence[str] = ()) -> str:
    """Sum of site moments: one intercept absorbed per site."""
    keys = ", ".join(by)
    items = [f"sum({s(a, b)}) AS {s(a, b)}" for a, b in pairs(cols)]
    head = f"{keys}, " if by else ""
    tail = f" GROUP BY {keys}" if by else ""
    return f"{name} AS (SELECT {head}sum(n) AS n, count(*) AS k, {', '.join(items)} FROM {src}{tail})"


def solve2(z: Sequence[str], v: str) -> tuple[str, str]:
    """Coefficients of v on two columns z from their cross-products."""
    a, b = z
    det = f"({s(a, a)}*{s(b, b)}-{s(a, b)}*{s(a, b)})"
    return (f"(({s(a, v)}*{s(b, b)}-{s(b, v)}*{s(a, b)})/{det})", f"(({s(b, v)}*{s(a, a)}-{s(a, v)}*{s(a, b)})/{det})")


def fs(name: str = "fs", src: str = "mom", z: Sequence[str] = ("snp0", "snp1"), x: str = "x") -> str:
    """Two-instrument first stage: slopes p0, p1 and intercept a0 per row of src."""
    p0, p1 = solve2(z, x)
    return f"{name} AS (SELECT *, m_{x} - p0*m_{z[0]} - p1*m_{z[1]} AS a0 FROM (SELECT *, {p0} AS p0, {p1} AS p1 FROM {src}))"


XH = """xh AS (SELECT mr.*, mr.x*mr.x AS x2, a0 + p0*mr.snp0 + p1*mr.snp1 AS xhat,
  (a0 + p0*mr.snp0 + p1*mr.snp1)*(a0 + p0*mr.snp0 + p1*mr.snp1) AS xhat2, x - (a0 + p0*mr.snp0 + p1*mr.snp1) AS resid
  FROM mr JOIN fs USING (site))"""


def local_rows() -> str:
    """mr with the per-site predicted exposure attached (CTE xh)."""
    return ",\n".join([MR, mom("mom", ["snp0", "snp1", "x", "y"]), fs(), XH])


GRID61 = "grid AS (SELECT CAST(k AS INT) AS k, -3e0 + k*0.1e0 AS x FROM range(61) r(k))"
GRID200 = f"fine AS (SELECT CAST(k AS INT) AS k, -2.5e0 + k*{5 / 199!r} AS x FROM range(200) r(k))"

EMB = """emb AS (SELECT vec_id, label, CAST(vec_id % 3 AS INT) AS round, unnest(range(len(embedding))) AS j,
  CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"""

# one update vector per (round, site): coordinate means, weight = rows behind it
UPD = EMB + """,
updw AS (SELECT CAST(vec_id % 3 AS INT) AS round, label AS site, CAST(count(*) AS DOUBLE) AS weight FROM embeddings GROUP BY 1, 2),
upd AS (SELECT e.round, e.label AS site, CAST(e.j AS INT) AS j, avg(e.v) AS v, max(w.weight) AS weight
  FROM emb e JOIN updw w ON e.round = w.round AND e.label = w.site GROUP BY 1, 2, 3)"""


def select(ctes: Sequence[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body
