"""DuckDB SQL for the queries of the catalogue: a chain of common table expressions, and a SELECT on top."""

from __future__ import annotations

import re

#: name -> (needed tables, SQL). Default settings; plane coordinates; base at the origin.
CHAIN: dict[str, tuple[tuple[str, ...], str]] = {
    "e": ((), "SELECT user_id, value, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS n FROM events"),
    "f": (("e",), "SELECT user_id % 5 AS project_id, user_id AS track_id, n, value, event_id, CAST(floor(n / 32.0::DOUBLE) AS BIGINT) AS lane, n % 32 AS k FROM e"),
    "fx0": (
        ("f",),
        """SELECT project_id, track_id, n, event_id,
  CASE WHEN event_id % 50 = 0 THEN 30.0::DOUBLE ELSE 3.0::DOUBLE END AS accuracy_m,
  CAST(track_id*86400 + lane*200 + CASE WHEN k<24 THEN k*2 WHEN k=24 THEN 52 WHEN k<31 THEN 60+(k-25)*12 ELSE 128 END
     + CASE WHEN track_id % 11 = 0 AND k>=24 THEN 60 ELSE 0 END AS DOUBLE) AS t,
  CASE WHEN k<24 THEN 12.0::DOUBLE + CAST(CAST(floor(track_id/5.0::DOUBLE) AS BIGINT)*2 + lane AS DOUBLE)
                 + CAST(CAST(floor(value*100.0::DOUBLE) AS BIGINT) % 21 AS DOUBLE)/100.0::DOUBLE
       WHEN k=24 THEN 10.0::DOUBLE
       WHEN k<31 THEN CAST(CAST(floor(value*100.0::DOUBLE) AS BIGINT) % 61 AS DOUBLE)/100.0::DOUBLE
       ELSE 10.0::DOUBLE END AS x,
  CASE WHEN k<24 THEN CAST(CASE WHEN k=12 AND track_id % 3 = 0 THEN (CASE WHEN lane % 2 = 0 THEN 11 ELSE 12 END)
                                WHEN lane % 2 = 0 THEN k ELSE 23-k END AS DOUBLE)
       WHEN k=24 THEN 6.0::DOUBLE WHEN k<31 THEN 0.5::DOUBLE ELSE 2.0::DOUBLE END AS y
FROM f""",
    ),
    "fx": (("fx0",), "SELECT *, 38.3005::DOUBLE + y / 111000.0::DOUBLE AS lat, 32.8985::DOUBLE + x / 87000.0::DOUBLE AS lon FROM fx0"),
    # accuracy filter, then positions with the base flag
    "ac": (("fx",), "SELECT *, CASE WHEN accuracy_m > 25.0::DOUBLE THEN 1 ELSE 0 END AS bad FROM fx"),
    "ok": (("ac",), "SELECT * EXCLUDE (bad, all_bad) FROM (SELECT *, min(bad) OVER (PARTITION BY project_id, track_id) AS all_bad FROM ac) WHERE bad = 0 OR all_bad = 1"),
    "pos": (("ok",), "SELECT *, sqrt(x*x + y*y) <= 8.0::DOUBLE AS in_base FROM ok"),
    "sg": (
        ("pos",),
        """SELECT project_id, track_id, CAST(row_number() OVER w - 1 AS INT) AS i, t AS t0, lead(t) OVER w AS t1, x AS ax, y AS ay,
  lead(x) OVER w AS bx, lead(y) OVER w AS by, in_base AS base0, lead(in_base) OVER w AS base1
FROM pos WINDOW w AS (PARTITION BY project_id, track_id ORDER BY n)""",
    ),
    "sd": (("sg",), "SELECT *, sqrt((bx-ax)*(bx-ax) + (by-ay)*(by-ay)) AS dist_m, t1 - t0 AS dt_s FROM sg WHERE t1 IS NOT NULL"),
    "sv": (("sd",), "SELECT *, CASE WHEN dt_s > 0 THEN dist_m / dt_s ELSE 0.0::DOUBLE END AS speed_ms FROM sd"),
    "ss": (
        ("sv",),
        """SELECT *, CASE WHEN dt_s > 45.0::DOUBLE THEN 4 WHEN base0 OR base1 THEN 3 WHEN speed_ms > 4.5::DOUBLE/3.6::DOUBLE THEN 2
  WHEN speed_ms < 0.4::DOUBLE/3.6::DOUBLE THEN 0 ELSE 1 END AS state FROM sv""",
    ),
    "ru": (("ss",), "SELECT *, i - (row_number() OVER (PARTITION BY project_id, track_id, state ORDER BY i) - 1) AS run FROM ss"),
    "wk0": (
        ("ru",),
        "SELECT *, min(i) OVER q AS first_i, max(i) OVER q AS last_i FROM ru WHERE state = 1 WINDOW q AS (PARTITION BY project_id, track_id, run)",
    ),
    "wk": (("wk0",), "SELECT *, CAST(dense_rank() OVER (PARTITION BY project_id, track_id ORDER BY first_i) - 1 AS INT) AS pass_no, i = first_i AS begins, i = last_i AS ends FROM wk0"),
    "ps": (
        ("wk",),
        "SELECT project_id, track_id, pass_no, min(i) AS start_i, max(i) + 1 AS end_i, min(t0) AS start_t, max(t1) AS end_t, sum(dist_m) AS distance_m FROM wk GROUP BY ALL",
    ),
    "vr": (
        ("pos",),
        """SELECT *, row_number() OVER (PARTITION BY project_id, track_id ORDER BY n) - row_number() OVER (PARTITION BY project_id, track_id, in_base ORDER BY n) AS run FROM pos""",
    ),
    "vi": (
        ("vr",),
        """SELECT project_id, track_id, CAST(row_number() OVER (PARTITION BY project_id, track_id ORDER BY start_t) - 1 AS INT) AS visit_no, start_t, end_t
FROM (SELECT project_id, track_id, run, min(t) AS start_t, max(t) AS end_t FROM vr WHERE in_base GROUP BY ALL) WHERE end_t - start_t >= 60.0::DOUBLE""",
    ),
    "rf": (("vi", "ps"), "SELECT * FROM vi WHERE end_t < (SELECT max(ps.end_t) FROM ps WHERE ps.project_id = vi.project_id AND ps.track_id = vi.track_id)"),
    "tk": (("pos",), "SELECT project_id, track_id, min(t) AS first_t, max(t) AS last_t, CAST(row_number() OVER (PARTITION BY project_id ORDER BY min(t), track_id) - 1 AS INT) AS track_ord FROM pos GROUP BY project_id, track_id"),
    "li": (
        ("rf", "tk"),
        """SELECT project_id, track_id, k, coalesce(from_t, first_t) AS start_t, start_t AS end_t, is_complete FROM (
  SELECT project_id, track_id, start_t, is_complete, CAST(row_number() OVER w - 1 AS INT) AS k, lag(end_t) OVER w AS from_t FROM (
    SELECT project_id, track_id, start_t, end_t, true AS is_complete FROM rf
    UNION ALL SELECT project_id, track_id, last_t, NULL, false FROM tk)
  WINDOW w AS (PARTITION BY project_id, track_id ORDER BY is_complete DESC, start_t)) JOIN tk USING (project_id, track_id)
WHERE start_t > coalesce(from_t, first_t)""",
    ),
    "lo": (
        ("li", "ps", "tk"),
        """SELECT li.*, track_ord, CAST(row_number() OVER (PARTITION BY li.project_id ORDER BY track_ord, start_t) - 1 AS INT) AS load_no FROM li JOIN tk USING (project_id, track_id)
WHERE EXISTS (SELECT 1 FROM ps WHERE ps.project_id = li.project_id AND ps.track_id = li.track_id AND ps.start_t < li.end_t AND ps.end_t > li.start_t)""",
    ),
    "pl": (
        ("ps", "lo"),
        """SELECT ps.*, load_no FROM ps JOIN lo ON ps.project_id = lo.project_id AND ps.track_id = lo.track_id
AND (ps.start_t + ps.end_t) / 2 BETWEEN lo.start_t AND lo.end_t""",
    ),
    "rg": (("ss",), "SELECT project_id, track_id, greatest(3 * quantile_cont(dt_s, 0.5), 10.0::DOUBLE) AS gap_s FROM ss WHERE state = 1 GROUP BY ALL"),
    "ex": (("wk",), "SELECT project_id, min(least(ax, bx)) AS x_min, max(greatest(ax, bx)) AS x_max, min(least(ay, by)) AS y_min, max(greatest(ay, by)) AS y_max FROM wk GROUP BY ALL"),
    "gd": (
        ("ex",),
        """SELECT DISTINCT ON (project_id) project_id, x0, y0, cell, CAST(nx AS BIGINT) AS nx, CAST(ny AS BIGINT) AS ny, k > 0 AS coarsened FROM (
  SELECT project_id, x_min - 4.0::DOUBLE AS x0, y_min - 4.0::DOUBLE AS y0, k, 0.25::DOUBLE * pow(2.0::DOUBLE, k) AS cell,
    greatest(1, ceil(((x_max + 4.0::DOUBLE) - (x_min - 4.0::DOUBLE)) / (0.25::DOUBLE * pow(2.0::DOUBLE, k)))) AS nx,
    greatest(1, ceil(((y_max + 4.0::DOUBLE) - (y_min - 4.0::DOUBLE)) / (0.25::DOUBLE * pow(2.0::DOUBLE, k)))) AS ny
  FROM ex, range(0, 25) AS q(k)) WHERE nx * ny <= 12000000 OR cell > 50 ORDER BY project_id, k""",
    ),
    "bx": (
        ("wk", "gd", "tk", "pl"),
        """SELECT wk.*, track_ord, load_no, x0, y0, cell,
  CAST(greatest(floor((least(ax,bx) - 0.5::DOUBLE - x0)/cell), 0) AS BIGINT) AS c0, CAST(least(ceil((greatest(ax,bx) + 0.5::DOUBLE - x0)/cell) + 1, nx) AS BIGINT) AS c1,
  CAST(greatest(floor((least(ay,by) - 0.5::DOUBLE - y0)/cell), 0) AS BIGINT) AS r0, CAST(least(ceil((greatest(ay,by) + 0.5::DOUBLE - y0)/cell) + 1, ny) AS BIGINT) AS r1
FROM wk JOIN gd USING (project_id) JOIN tk USING (project_id, track_id) JOIN pl USING (project_id, track_id, pass_no) WHERE dist_m > 0""",
    ),
    "cd0": (("bx",), "SELECT *, unnest(range(c0, c1)) AS c FROM bx"),
    "cd": (("cd0",), "SELECT *, unnest(range(r0, r1)) AS r FROM cd0"),
    "ce": (("cd",), "SELECT *, x0 + (c + 0.5::DOUBLE)*cell AS gx, y0 + (r + 0.5::DOUBLE)*cell AS gy, bx - ax AS dx, by - ay AS dy FROM cd"),
    "cf": (("ce",), "SELECT *, ((gx-ax)*dx + (gy-ay)*dy)/(dx*dx + dy*dy) AS along FROM ce"),
    "cg": (("cf",), "SELECT *, gx - (ax + least(greatest(along, 0.0::DOUBLE), 1.0::DOUBLE)*dx) AS ex, gy - (ay + least(greatest(along, 0.0::DOUBLE), 1.0::DOUBLE)*dy) AS ey FROM cf"),
    "hit": (
        ("cg",),
        "SELECT project_id, track_id, track_ord, load_no, pass_no, i, t1, r, c FROM cg WHERE ex*ex + ey*ey <= 0.25::DOUBLE AND (NOT begins OR along >= 0) AND (NOT ends OR along <= 1)",
    ),
    "to0": (("hit", "rg"), "SELECT hit.*, gap_s, lag(t1) OVER (PARTITION BY project_id, r, c ORDER BY track_ord, i) AS before FROM hit JOIN rg USING (project_id, track_id)"),
    "tou": (("to0",), "SELECT *, before IS NULL OR t1 - before > gap_s AS fresh FROM to0"),
    "cel": (("tou",), "SELECT project_id, r, c, CAST(count(*) FILTER (fresh) AS INT) AS passes, min(track_ord) AS first_track_ord FROM tou GROUP BY ALL"),
    "his": (("cel", "gd"), "SELECT project_id, passes, count(*) AS n_cells, count(*) * any_value(cell) * any_value(cell) AS area_m2 FROM cel JOIN gd USING (project_id) GROUP BY project_id, passes"),
    # work per project, passes only
    "ld": (
        ("lo", "hit", "gd"),
        """SELECT lo.*, area_m2 FROM lo JOIN (SELECT project_id, load_no, count(*) * any_value(cell) * any_value(cell) AS area_m2
  FROM (SELECT DISTINCT project_id, load_no, r, c FROM hit) JOIN gd USING (project_id) GROUP BY project_id, load_no) USING (project_id, load_no)""",
    ),
    "vo0": (("ld",), "SELECT *, avg(area_m2) FILTER (is_complete AND area_m2 > 0) OVER (PARTITION BY project_id) AS mean_m2 FROM ld"),
    "vo": (
        ("vo0",),
        "SELECT *, CASE WHEN is_complete OR mean_m2 IS NULL THEN 18.0::DOUBLE ELSE 18.0::DOUBLE * least(1.0::DOUBLE, area_m2 / mean_m2) END AS volume_l FROM vo0",
    ),
    # the boundary of the tests: a rectangle and a triangle in every project
    "rings": (
        ("gd",),
        """SELECT project_id, ring_id, pts FROM gd, (VALUES
  (1, [[11.5::DOUBLE, -2.0::DOUBLE], [30.0, -2.0], [30.0, 26.0], [11.5, 26.0]]),
  (2, [[30.0::DOUBLE, 0.0::DOUBLE], [60.0, 0.0], [45.0, 20.0]])) AS q(ring_id, pts)""",
    ),
    "pcell": (
        ("rings", "gd"),
        """SELECT DISTINCT project_id, r, c FROM (
  SELECT rings.project_id, ring_id, pts, r, c, x0 + (c + 0.5::DOUBLE)*cell AS gx, y0 + (r + 0.5::DOUBLE)*cell AS gy
  FROM rings JOIN gd USING (project_id), range(0, nx) AS a(c), range(0, ny) AS b(r)
  WHERE x0 + (c + 0.5::DOUBLE)*cell BETWEEN 11.0 AND 61.0 AND y0 + (r + 0.5::DOUBLE)*cell BETWEEN -3.0 AND 27.0)
WHERE len(list_filter(range(1, len(pts) + 1), lambda i: (pts[i][2] > gy) <> (pts[i % len(pts) + 1][2] > gy)
    AND gx < (pts[i % len(pts) + 1][1] - pts[i][1]) * (gy - pts[i][2]) / (pts[i % len(pts) + 1][2] - pts[i][2]) + pts[i][1])) % 2 = 1
  OR len(list_filter(range(1, len(pts) + 1), lambda i: (pts[i % len(pts) + 1][1] - pts[i][1]) * (gy - pts[i][2]) - (pts[i % len(pts) + 1][2] - pts[i][2]) * (gx - pts[i][1]) = 0
    AND gx BETWEEN least(pts[i][1], pts[i % len(pts) + 1][1]) AND greatest(pts[i][1], pts[i % len(pts) + 1][1])
    AND gy BETWEEN least(pts[i][2], pts[i % len(pts) + 1][2]) AND greatest(pts[i][2], pts[i % len(pts) + 1][2]))) > 0""",
    ),
    "fld": (("pcell", "cel"), "SELECT project_id, r, c FROM pcell UNION SELECT project_id, r, c FROM cel"),
    "gap": (("fld", "cel"), "SELECT project_id, r, c FROM fld EXCEPT SELECT project_id, r, c FROM cel"),
    "sta": (
        ("fld", "cel", "gap", "gd"),
        """SELECT project_id, field * m2 AS field_area_m2, sprayed * m2 AS sprayed_area_m2, gaps * m2 AS gap_area_m2, twice * m2 AS overlap_area_m2, thrice * m2 AS heavy_overlap_area_m2, mean_passes
FROM (SELECT project_id, cell * cell AS m2 FROM gd)
JOIN (SELECT project_id, count(*) AS field FROM fld GROUP BY 1) USING (project_id)
JOIN (SELECT project_id, count(*) AS sprayed, count(*) FILTER (passes >= 2) AS twice, count(*) FILTER (passes >= 3) AS thrice, avg(passes) AS mean_passes FROM cel GROUP BY 1) USING (project_id)
JOIN (SELECT project_id, count(*) AS gaps FROM gap GROUP BY 1) USING (project_id)""",
    ),
}


#: Heads of tables that are found by recursion.
HEADS: dict[str, str] = {}


def _labels(name: str, cells: str) -> None:
    """Adds <name>r, runs of a row of the table ``cells``; <name>e, runs that touch in the next row; <name>l: node, root.

    A run's node is its project, row and first column; the root is the least node of its component.
    """
    CHAIN[name + "r"] = ((cells,), f"""SELECT project_id, r, min(c) AS c0, max(c) AS c1, (project_id << 50) + (r << 25) + min(c) AS node
FROM (SELECT project_id, r, c, c - row_number() OVER (PARTITION BY project_id, r ORDER BY c) AS run FROM {cells}) GROUP BY project_id, r, run""")
    CHAIN[name + "d"] = ((name + "r",), f"""SELECT a.node AS a, b.node AS b FROM {name}r a JOIN {name}r b ON a.project_id = b.project_id AND b.r = a.r + 1 AND b.c0 <= a.c1 AND b.c1 >= a.c0""")
    CHAIN[name + "e"] = ((name + "d",), f"SELECT a, b FROM {name}d UNION ALL SELECT b, a FROM {name}d")
    HEADS[name + "l"] = f"{name}l(node, root) USING KEY (node)"
    CHAIN[name + "l"] = ((name + "r", name + "e"), f"""SELECT node, node FROM {name}r UNION
(SELECT e.b, min(l.root) FROM {name}l l JOIN {name}e e ON e.a = l.node JOIN recurring.{name}l o ON o.node = e.b WHERE l.root < o.root GROUP BY e.b)""")


_labels("gap_", "gap")
#: Patches of missed ground that are no specks, ranked; their cells; the squared distance to what is of no patch.
CHAIN["pk"] = (
    ("gap_r", "gap_l", "gd"),
    """SELECT project_id, root, n, CAST(row_number() OVER (PARTITION BY project_id ORDER BY n DESC, root) AS INT) AS patch FROM (
  SELECT project_id, root, CAST(sum(c1 - c0 + 1) AS BIGINT) AS n FROM gap_r JOIN gap_l USING (node) GROUP BY project_id, root) JOIN gd USING (project_id) WHERE n >= greatest(1, round_even(2.0::DOUBLE / (cell * cell), 0))""",
)
CHAIN["pt"] = (("gap_r", "gap_l", "pk"), "SELECT project_id, r, unnest(range(c0, c1 + 1)) AS c, patch FROM gap_r JOIN gap_l USING (node) JOIN pk USING (project_id, root)")
CHAIN["dv"] = (
    ("pt",),
    """SELECT project_id, r, c, patch, least(r - min(r) OVER v, max(r) OVER v - r) + 1 AS up, min(c) OVER h AS lo, max(c) OVER h AS hi, across FROM (
  SELECT *, r - row_number() OVER (PARTITION BY project_id, c ORDER BY r) AS down, c - row_number() OVER (PARTITION BY project_id, r ORDER BY c) AS across FROM pt)
WINDOW v AS (PARTITION BY project_id, c, down), h AS (PARTITION BY project_id, r, across)""",
)
CHAIN["pd"] = (
    ("dv",),
    """SELECT a.project_id, a.r, a.c, any_value(a.patch) AS patch, CAST(least(min((a.c - b.c) * (a.c - b.c) + b.up * b.up), any_value((a.c - a.lo + 1) * (a.c - a.lo + 1)), any_value((a.hi + 1 - a.c) * (a.hi + 1 - a.c))) AS BIGINT) AS d2
FROM dv a JOIN dv b ON a.project_id = b.project_id AND a.r = b.r AND a.across = b.across GROUP BY a.project_id, a.r, a.c""",
)
CHAIN["pm"] = (
    ("pd", "gd"),
    """SELECT project_id, patch, count(*) AS n_cells, count(*) * any_value(cell * cell) AS area_m2, any_value(x0) + (avg(c) + 0.5::DOUBLE) * any_value(cell) AS x,
  any_value(y0) + (avg(r) + 0.5::DOUBLE) * any_value(cell) AS y, 2 * sqrt(CAST(max(d2) AS DOUBLE)) * any_value(cell) AS max_width_m FROM pd JOIN gd USING (project_id) GROUP BY project_id, patch""",
)
#: Corners of the patches' cells, and which of the four cells around each are of the patch; the sides of the cells.
CHAIN["pc"] = (
    ("pt",),
    """SELECT project_id, patch, c + dx AS x, r + dy AS y, count(*) AS k, bit_or(1 << (dx + 2 * dy)) AS which FROM pt, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) AS q(dx, dy) GROUP BY ALL""",
)
CHAIN["pe"] = (
    ("pt",),
    """SELECT project_id, patch, x, y, flat, count(*) AS k FROM (SELECT project_id, patch, c AS x, r AS y, true AS flat FROM pt UNION ALL SELECT project_id, patch, c, r + 1, true FROM pt
  UNION ALL SELECT project_id, patch, c, r, false FROM pt UNION ALL SELECT project_id, patch, c + 1, r, false FROM pt) GROUP BY ALL""",
)
#: The covered cells closed by a disk of eight cells, the ground between them, and the inferred plot.
DISK = "(SELECT a, b FROM range(-8, 9) p(a), range(-8, 9) q(b) WHERE a*a + b*b <= 64)"
CHAIN["wide"] = (("cel",), f"SELECT DISTINCT project_id, r + a AS r, c + b AS c FROM cel, {DISK}")
CHAIN["clo"] = (("wide",), f"SELECT project_id, r - a AS r, c - b AS c FROM wide, {DISK} GROUP BY project_id, r - a, c - b HAVING count(*) = (SELECT count(*) FROM {DISK})")
CHAIN["cbox"] = (("clo",), "SELECT project_id, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM clo GROUP BY project_id")
CHAIN["opn"] = (("cbox", "clo"), "SELECT project_id, r, unnest(range(c0, c1 + 1)) AS c FROM (SELECT project_id, c0, c1, unnest(range(r0, r1 + 1)) AS r FROM cbox) EXCEPT SELECT project_id, r, c FROM clo")
_labels("opn_", "opn")
CHAIN["inf"] = (
    ("opn_r", "opn_l", "cbox", "clo"),
    """SELECT project_id, r, c FROM clo UNION ALL SELECT project_id, r, unnest(range(c0, c1 + 1)) AS c FROM opn_r JOIN opn_l USING (node) WHERE root NOT IN (
  SELECT root FROM opn_r JOIN opn_l USING (node) JOIN cbox b USING (project_id) WHERE opn_r.r IN (b.r0, b.r1) OR opn_r.c0 = b.c0 OR opn_r.c1 = b.c1)""",
)


def over(select: str, *needs: str) -> str:
    """``select`` with the tables of the chain that it needs."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in CHAIN[name][0]:
            if n not in order:
                add(n)
        if name not in order:
            order.append(name)

    for n in needs:
        add(n)
    sql = "WITH " + "RECURSIVE " * any(n in HEADS for n in order) + ",\n".join(f"{HEADS.get(n, n)} AS ({CHAIN[n][1]})" for n in order) + "\n" + select
    return re.sub(r"\bby\b", '"by"', sql)  # the column by is a keyword there; keywords are upper case here
