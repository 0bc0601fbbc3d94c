"""SQL of the queries in quadrat.plans.queries, for DuckDB over the same tables."""

from __future__ import annotations

SQL: dict[str, str] = {}


def r6(x: str) -> str:
    return f"(round({x}, 6) + 0.0)"


def _pairs(table: str, key: str, test: str) -> str:
    return f"SELECT a.{key}::BIGINT AS i, b.{key}::BIGINT AS j FROM {table} a JOIN {table} b ON a.{key} {test} b.{key}"


SQL["pairs_strict"] = _pairs("nation", "n_nationkey", "<")
SQL["pairs_inclusive"] = _pairs("nation", "n_nationkey", "<=")
SQL["pairs_tiled"] = _pairs("supplier", "s_suppkey", "<")
SQL["tile_sizes"] = """
WITH p AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer)
SELECT (a.pos // 100)::BIGINT AS ti, (b.pos // 100)::BIGINT AS tj, count(*)::BIGINT AS pairs FROM p a JOIN p b ON a.pos < b.pos GROUP BY 1, 2"""
SQL["tile_closed_form"] = """
WITH p AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS pos FROM supplier)
SELECT (a.pos // 30)::BIGINT AS ti, (b.pos // 30)::BIGINT AS tj, count(*) FILTER (a.pos < b.pos)::BIGINT AS strict_pairs, count(*) FILTER (a.pos <= b.pos)::BIGINT AS inclusive_pairs
FROM p a CROSS JOIN p b GROUP BY 1, 2"""
SQL["triangle_sizes"] = """
SELECT o_orderpriority, count(*)::BIGINT AS n, (count(*) * (count(*) - 1) // 2)::BIGINT AS strict_pairs, (count(*) * (count(*) + 1) // 2)::BIGINT AS inclusive_pairs
FROM orders GROUP BY 1"""


def _hilbert(bits: int) -> str:
    sql = """SELECT a.pos AS i, b.pos AS j, a.pos AS x, b.pos AS y, 0::BIGINT AS d
FROM (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS pos FROM nation) a JOIN (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS pos FROM nation) b ON a.pos <= b.pos"""
    for k in reversed(range(bits)):
        s = 1 << k
        sql = f"""SELECT i, j, CASE WHEN ry = 0 THEN fy ELSE fx END AS x, CASE WHEN ry = 0 THEN fx ELSE fy END AS y, d FROM (
SELECT i, j, d + {s * s} * xor(3 * rx, ry) AS d, ry, CASE WHEN ry = 0 AND rx = 1 THEN {s - 1} - (x & {s - 1}) ELSE x & {s - 1} END AS fx, CASE WHEN ry = 0 AND rx = 1 THEN {s - 1} - (y & {s - 1}) ELSE y & {s - 1} END AS fy
FROM (SELECT *, ((x & {s}) > 0)::BIGINT AS rx, ((y & {s}) > 0)::BIGINT AS ry FROM ({sql})))"""
    return f"SELECT i::BIGINT AS i, j::BIGINT AS j, d::BIGINT AS hilbert FROM ({sql})"


SQL["hilbert_order"] = _hilbert(5)


def _dense(score: str, name: str, below: str = "", test: str = "<", prep: str = "embedding::DOUBLE[]") -> str:
    return f"""WITH v AS (SELECT vec_id, {prep} AS e FROM embeddings {below})
SELECT a.vec_id::BIGINT AS i, b.vec_id::BIGINT AS j, {r6(score)} AS {name} FROM v a JOIN v b ON a.vec_id {test} b.vec_id"""


_DOT = "list_dot_product(a.e, b.e)"
_COSINE = f"{_DOT} / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e))"
_CENTRED = "list_transform(embedding::DOUBLE[], lambda x: x - list_avg(embedding::DOUBLE[]))"
_NCC = f"{_DOT} / sqrt(list_dot_product(a.e, a.e) - list_sum(a.e) * list_sum(a.e)) / sqrt(list_dot_product(b.e, b.e) - list_sum(b.e) * list_sum(b.e))"
SQL["emb_dot"] = _dense(_DOT, "dot")
SQL["emb_cosine"] = _dense(_COSINE, "cosine")
SQL["emb_ncc"] = _dense(_NCC, "ncc", prep=_CENTRED)
SQL["emb_dot_theta"] = _dense(_DOT, "dot", "WHERE vec_id < 200", "<=")
SQL["pair_error_column"] = f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id < 20)
SELECT a.vec_id::BIGINT AS i, b.vec_id::BIGINT AS j, CASE WHEN a.vec_id <> 7 AND b.vec_id <> 7 THEN {r6(_DOT)} END AS dot, a.vec_id = 7 OR b.vec_id = 7 AS failed
FROM v a JOIN v b ON a.vec_id < b.vec_id"""
_FEW = f"WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id < 40), m AS (SELECT a.vec_id AS i, b.vec_id AS j, CASE WHEN a.vec_id = b.vec_id THEN 0.0 ELSE {r6(_DOT)} END AS c FROM v a CROSS JOIN v b)"
SQL["pair_matrix_symmetric"] = f"{_FEW} SELECT i::BIGINT AS i, j::BIGINT AS j, c FROM m"
SQL["edge_list"] = f"{_FEW} SELECT 'v' || i || ' v' || j || ' ' || printf('%.6f', c) AS line FROM m WHERE j < i"
SQL["matrix_text"] = f"{_FEW} SELECT i::BIGINT AS row, string_agg(printf('%.6f, ', c), '' ORDER BY j) AS line FROM m GROUP BY 1"

# -- sequences

SQL["fasta_clean"] = r"""
WITH s AS (SELECT doc_id, translate(regexp_replace(regexp_replace(text, '(>)[^\n]*|[#;][^\n]*', '\1', 'g'), '[ \t\n]', '', 'g'), '>', chr(10)) AS q FROM documents)
SELECT doc_id, length(q)::BIGINT AS letters, regexp_matches(q, '[^A-Z\n]') AS invalid FROM s"""


def _kmers(below: str = "") -> str:
    """CTEs c (counts), p (probabilities), x (expectations), a (alphas), v (vectors) for k = 3 over ACGT."""
    code = "list_sum([(instr('ACGT', substr(m, t::INT, 1)) - 1) * (4 ** (n - t))::BIGINT for t in range(1, n + 1)])::BIGINT"
    return f"""
WITH r AS (SELECT doc_id AS doc, unnest(string_split_regex(upper(text), '[^ACGT]+')) AS run FROM documents {below}),
w AS (SELECT doc, run, n, unnest(range(1, length(run) - n + 2)) AS o FROM r, (SELECT unnest([3, 2, 1]) AS n) WHERE length(run) >= n),
k AS (SELECT doc, n, substr(run, o::INT, n) AS m FROM w),
c AS (SELECT doc, n, m, {code} AS code, count(*) AS cnt FROM k GROUP BY doc, n, m),
p AS (SELECT doc, n, m, code, cnt / sum(cnt) OVER (PARTITION BY doc, n) AS p FROM c),
x AS (SELECT a.doc, a.m || b.m[2] AS m, a.code * 4 + b.code % 4 AS code, a.p * b.p / mid.p AS p0
      FROM p a JOIN p b ON a.doc = b.doc AND a.n = 2 AND b.n = 2 AND a.m[2] = b.m[1] JOIN p mid ON mid.doc = a.doc AND mid.n = 1 AND mid.m = a.m[2]),
a AS (SELECT x.doc, x.code, (coalesce(p.p, 0) - p0) / p0 AS alpha FROM x LEFT JOIN p ON p.doc = x.doc AND p.n = 3 AND p.code = x.code),
v AS (SELECT doc, code, alpha / sqrt(sum(alpha * alpha) OVER (PARTITION BY doc)) AS val FROM a WHERE alpha <> 0)
"""


SQL["kmer_count"] = _kmers() + "SELECT doc, n::INT AS n, code, cnt::BIGINT AS cnt FROM c"
SQL["kmer_prob"] = _kmers() + f"SELECT doc, n::INT AS n, code, {r6('p')} AS p FROM p"
SQL["kmer_expect"] = _kmers() + f"SELECT doc, code, {r6('p0')} AS p0 FROM x"
SQL["kmer_alpha"] = _kmers() + f"SELECT doc, code, {r6('alpha')} AS alpha FROM a WHERE alpha <> 0"
SQL["cv_norm"] = _kmers() + f"SELECT doc, code, {r6('val')} AS val FROM v"
_DOTS = "SELECT a.doc AS i, b.doc AS j, sum(a.val * b.val) AS dot FROM v a JOIN v b ON a.code = b.code AND a.doc <= b.doc GROUP BY 1, 2"
SQL["cv_cosine"] = _kmers("WHERE doc_id < 300") + f""", s AS ({_DOTS}), d AS (SELECT doc_id FROM documents WHERE doc_id < 300)
SELECT a.doc_id AS i, b.doc_id AS j, {r6('coalesce(s.dot, 0)')} AS cosine FROM d a JOIN d b ON a.doc_id <= b.doc_id LEFT JOIN s ON s.i = a.doc_id AND s.j = b.doc_id"""
SQL["cv_sparse_dot"] = _kmers("WHERE doc_id < 100") + f"SELECT i, j, {r6('dot')} AS dot FROM ({_DOTS})"
SQL["cv_size_report"] = _kmers() + """
SELECT * FROM (SELECT length(text)::BIGINT AS max_chars, doc_id AS max_chars_doc FROM documents ORDER BY length(upper(text)) DESC, doc_id LIMIT 1)
CROSS JOIN (SELECT count(*)::BIGINT AS max_entries, doc AS max_entries_doc FROM v GROUP BY doc ORDER BY count(*) DESC, doc LIMIT 1)"""

# -- images

_PX = """
whole AS (SELECT vec_id // 16 AS img FROM embeddings GROUP BY 1 HAVING count(*) = 16),
e AS (SELECT vec_id, vec_id // 16 AS img, generate_subscripts(embedding, 1) - 1 AS k, unnest(embedding)::DOUBLE AS v FROM embeddings),
px AS (SELECT img::BIGINT AS img, (2 * (vec_id % 16) + k // 32)::INT AS y, (k % 32)::INT AS x, v FROM e WHERE img IN (SELECT img FROM whole))"""


def _image(ctes: str, select: str) -> str:
    return f"WITH {_PX}{', ' + ctes if ctes else ''} {select}"


def _stencil(value: str, axis: str, source: str) -> str:
    other = "y" if axis == "x" else "x"
    w = f"(PARTITION BY img, {other} ORDER BY {axis})"
    return f"CASE WHEN {axis} = 0 THEN lead({value}) OVER {w} - {value} WHEN {axis} = 31 THEN {value} - lag({value}) OVER {w} ELSE (lead({value}) OVER {w} - lag({value}) OVER {w}) / 2 END"


_GRADIENT = f"""g0 AS (SELECT img, y, x, {_stencil('v', 'x', 'px')} AS dx, {_stencil('v', 'y', 'px')} AS dy FROM px),
g AS (SELECT img, y, x, dx / (1 + sqrt(dx * dx + dy * dy)) AS dx, dy / (1 + sqrt(dx * dx + dy * dy)) AS dy FROM g0)"""
_OUT = "img, y, x"
SQL["img_gray"] = _image("b AS (SELECT img, y, x, floor(abs(v) * 100000)::BIGINT AS t FROM px)", f"SELECT {_OUT}, {r6('0.299 * ((t // 11) % 256) + 0.587 * ((t // 7) % 256) + 0.114 * (t % 256)')} AS v FROM b")
SQL["img_gradient_x"] = _image(_GRADIENT, f"SELECT {_OUT}, {r6('dx')} AS v FROM g")
SQL["img_gradient_y"] = _image(_GRADIENT, f"SELECT {_OUT}, {r6('dy')} AS v FROM g")
_DIVERGENCE = f"{_GRADIENT}, n AS (SELECT img, y, x, {_stencil('dx', 'x', 'g')} + {_stencil('dy', 'y', 'g')} AS v FROM g)"
SQL["img_divergence"] = _image(_DIVERGENCE, f"SELECT {_OUT}, {r6('v')} AS v FROM n")


def _zero_mean(source: str) -> str:
    return f"z0 AS (SELECT img, y, x, v - avg(v) OVER (PARTITION BY img, x, y % 2) AS v FROM {source}), z AS (SELECT img, y, x, v - avg(v) OVER (PARTITION BY img, y, x % 2) AS v FROM z0)"


SQL["img_zeromean"] = _image(_zero_mean("px"), f"SELECT {_OUT}, {r6('v')} AS v FROM z")
SQL["img_transpose"] = _image("", f"SELECT img, x AS y, y AS x, {r6('v')} AS v FROM px")


def _dft(source: str) -> str:
    """f: the 2-D transform of source, by rows and then by columns."""
    return f"""ks AS (SELECT unnest(range(32))::INT AS k),
f0 AS (SELECT img, y, k AS kx, sum(v * cos(-2 * pi() * k * x / 32)) AS re, sum(v * sin(-2 * pi() * k * x / 32)) AS im FROM {source}, ks GROUP BY 1, 2, 3),
f AS (SELECT img, k AS ky, kx, sum(re * cos(-2 * pi() * k * y / 32) - im * sin(-2 * pi() * k * y / 32)) AS re, sum(re * sin(-2 * pi() * k * y / 32) + im * cos(-2 * pi() * k * y / 32)) AS im FROM f0, ks GROUP BY 1, 2, 3)"""


_LOCAL = "l AS (SELECT a.img, a.ky, a.kx, " + "least(" + ", ".join(f"sum(CASE WHEN abs(b.ky - a.ky) <= {r} AND abs(b.kx - a.kx) <= {r} THEN b.re * b.re + b.im * b.im ELSE 0 END) / {(2 * r + 1) ** 2}" for r in (1, 2, 3, 4)) + ") AS v FROM f a JOIN f b ON a.img = b.img AND abs(a.ky - b.ky) <= 4 AND abs(a.kx - b.kx) <= 4 GROUP BY 1, 2, 3)"


def _wiener(source: str) -> str:
    return f"""{_dft(source)}, {_LOCAL}, gv AS (SELECT img, sum(v * v) * count(*) / (count(*) - 1) AS g FROM {source} GROUP BY 1),
h AS (SELECT f.img, f.ky, f.kx, re * g / greatest(g, v) AS re, im * g / greatest(g, v) AS im FROM f JOIN l USING (img, ky, kx) JOIN gv USING (img)),
i0 AS (SELECT img, ky, k AS x, sum(re * cos(2 * pi() * k * kx / 32) - im * sin(2 * pi() * k * kx / 32)) AS re, sum(re * sin(2 * pi() * k * kx / 32) + im * cos(2 * pi() * k * kx / 32)) AS im FROM h, ks GROUP BY 1, 2, 3),
i1 AS (SELECT img, k AS y, x, sum(re * cos(2 * pi() * k * ky / 32) - im * sin(2 * pi() * k * ky / 32)) / 1024 AS v FROM i0, ks GROUP BY 1, 2, 3)"""


SQL["img_power"] = _image(_dft("px"), f"SELECT img, ky AS y, kx AS x, {r6('re * re + im * im')} AS v FROM f")
SQL["img_localvar"] = _image(f"{_dft('px')}, {_LOCAL}", f"SELECT img, ky AS y, kx AS x, {r6('v')} AS v FROM l")
SQL["img_wiener"] = _image(_wiener("px"), f"SELECT img, y, x::INT AS x, {r6('v')} AS v FROM i1")
SQL["img_pattern"] = _image(f"{_DIVERGENCE}, {_zero_mean('n')}, {_wiener('z')}", f"SELECT img, y, x::INT AS x, {r6('v')} AS v FROM i1")
SQL["img_spectrum"] = _image(_dft("px"), f"SELECT img, ky, kx, {r6('re')} AS re, {r6('im')} AS im FROM f WHERE kx <= 16")


def _xcorr(below: int) -> str:
    return f"""cc AS (SELECT a.img AS i, b.img AS j, (b.y - a.y + 32) % 32 AS dy, (b.x - a.x + 32) % 32 AS dx, sum(a.v * b.v) AS v
FROM px a JOIN px b ON a.img < b.img AND b.img < {below} GROUP BY 1, 2, 3, 4)"""


SQL["img_xcorr"] = _image(_xcorr(4), f"SELECT i, j, dy, dx, {r6('v')} AS v FROM cc")
SQL["img_pce"] = _image(_xcorr(6) + ", pk AS (SELECT i, j, arg_max(dy, abs(v)) AS py, arg_max(dx, abs(v)) AS px, arg_max(v, abs(v)) AS peak FROM cc GROUP BY 1, 2)", f"""
SELECT i, j, {r6('any_value(peak * peak) / (sum(v * v) FILTER (NOT (abs(dy - py) < 5 AND abs(dx - px) < 5)) / (1024 - 121))')} AS pce FROM cc JOIN pk USING (i, j) GROUP BY 1, 2""")

_COMPAT = f"""{_dft('px')},
c AS (SELECT a.img AS i, b.img AS j, ky, kx, a.re * b.re + a.im * b.im AS re, a.re * b.im - a.im * b.re AS im FROM f a JOIN f b USING (ky, kx) WHERE a.img < b.img AND b.img < 6 AND kx <= 16),
s1 AS (SELECT i, j, kx, k AS dy, sum(re * cos(2 * pi() * k * ky / 32) - im * sin(2 * pi() * k * ky / 32)) AS re, sum(re * sin(2 * pi() * k * ky / 32) + im * cos(2 * pi() * k * ky / 32)) AS im FROM c, ks GROUP BY 1, 2, 3, 4),
s2 AS (SELECT i, j, dy, k AS dx, re * cos(2 * pi() * k * kx / 32) - im * sin(2 * pi() * k * kx / 32) AS v, kx BETWEEN 1 AND 15 AS twice FROM s1, ks),
s3 AS (SELECT i, j, dy, dx, sum(v) AS a, sum(CASE WHEN twice THEN v ELSE 0 END) AS b FROM s2 GROUP BY 1, 2, 3, 4),
cc AS (SELECT p.i, p.j, p.dy, p.dx, (p.a + q.b) / 1024 AS v FROM s3 p JOIN s3 q ON p.i = q.i AND p.j = q.j AND p.dx = q.dx AND q.dy = (32 - p.dy) % 32)"""
SQL["img_pce_compat"] = _image(_COMPAT + ", pk AS (SELECT i, j, arg_max(dy, abs(v)) AS py, arg_max(dx, abs(v)) AS px, max(CASE WHEN dy = 31 AND dx = 31 THEN v END) AS peak FROM cc GROUP BY 1, 2)", f"""
SELECT i, j, {r6('any_value(peak * peak) / (sum(v * v) FILTER (NOT (abs(dy - py) < 5 AND abs(dx - px) < 5)) / (1024 - 121))')} AS pce FROM cc JOIN pk USING (i, j) GROUP BY 1, 2""")

# -- point clouds

_POINTS = """pts AS (SELECT user_id AS particle, value / 100 AS x, (extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + floor(extract(second FROM ts))) / 20000.0 AS y,
regexp_extract(props, '([0-9]+)', 1)::DOUBLE / 100 + 0.1 AS sigma FROM events)"""
_POINT_PAIRS = "pp AS (SELECT a.particle AS i, b.particle AS j, a.x AS ax, a.y AS ay, a.x - b.x AS dx, a.y - b.y AS dy, a.sigma + b.sigma AS s FROM pts a JOIN pts b ON a.particle <= b.particle AND b.particle < 12)"
SQL["pts_rigid"] = f"WITH {_POINTS} SELECT particle, {r6('x * cos(0.5) - y * sin(0.5) + 1')} AS x, {r6('x * sin(0.5) + y * cos(0.5) + 2')} AS y FROM pts"
_E = "exp(-(dx * dx + dy * dy) / 1.69)"
SQL["pts_gauss_cost"] = f"""WITH {_POINTS}, {_POINT_PAIRS} SELECT i, j, {r6(f'avg({_E})')} AS cost,
{r6(f'avg(-2 * {_E} * dx) / 1.69')} AS gx, {r6(f'avg(-2 * {_E} * dy) / 1.69')} AS gy, {r6(f'avg(-2 * {_E} * (dy * ax - dx * ay)) / 1.69')} AS gtheta FROM pp GROUP BY 1, 2"""
SQL["pts_expdist"] = f"WITH {_POINTS}, {_POINT_PAIRS} SELECT i, j, {r6('sum(exp(-(dx * dx + dy * dy) / s))')} AS score FROM pp GROUP BY 1, 2"

SQL["pts_resample_weights"] = f"""WITH {_POINTS},
span AS (SELECT particle, min(x) AS x0, CASE WHEN max(x) > min(x) THEN max(x) - min(x) ELSE 1 END AS sx, min(y) AS y0, CASE WHEN max(y) > min(y) THEN max(y) - min(y) ELSE 1 END AS sy FROM pts GROUP BY 1),
placed AS (SELECT particle, x, y, least(floor((x - x0) / sx * 100), 99) AS u, least(floor((y - y0) / sy * 100), 99) AS v FROM pts JOIN span USING (particle)),
bins AS (SELECT particle, u, v, count(*) AS n FROM placed GROUP BY 1, 2, 3),
w AS (SELECT a.particle, a.u, a.v, sum(b.n * exp(-0.5 * ((a.u - b.u) / 2) ** 2) * exp(-0.5 * ((a.v - b.v) / 2) ** 2)) AS weight
      FROM bins a JOIN bins b ON a.particle = b.particle AND abs(a.u - b.u) <= 7 AND abs(a.v - b.v) <= 7 GROUP BY 1, 2, 3)
SELECT particle, {r6('x')} AS x, {r6('y')} AS y, {r6('weight')} AS weight FROM placed JOIN w USING (particle, u, v)"""

# -- clusters


def _clusters(test: str) -> str:
    """w: the clusters after each step that joins the most similar two, as long as their similarity passes the test."""
    return f"""WITH RECURSIVE v AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id < 60),
base AS (SELECT a.pos AS x, b.pos AS y, {r6(_DOT)} AS c FROM v a JOIN v b ON a.pos <> b.pos),
w AS (
  SELECT 0 AS step, NULL::BIGINT AS n1, NULL::BIGINT AS n2, NULL::DOUBLE AS sim, NULL::BIGINT AS size, pos AS slot, pos AS id, [pos] AS members FROM v
  UNION ALL
  SELECT w.step + 1, l.id, r.id, best.sim, len(l.members) + len(r.members), w.slot,
         CASE WHEN w.slot = l.slot THEN (SELECT count(*) FROM v) + w.step ELSE w.id END, CASE WHEN w.slot = l.slot THEN list_concat(l.members, r.members) ELSE w.members END
  FROM w, (SELECT a.slot AS sa, b.slot AS sb, avg(c) AS sim FROM (SELECT slot, unnest(members) AS x FROM w) a JOIN (SELECT slot, unnest(members) AS y FROM w) b ON a.slot < b.slot JOIN base USING (x, y) GROUP BY 1, 2 ORDER BY sim DESC, sa, sb LIMIT 1) best
  JOIN w l ON l.slot = best.sa JOIN w r ON r.slot = best.sb
  WHERE w.slot <> r.slot AND best.sim {test})"""


SQL["cluster_linkage"] = f"{_clusters('> 0')} SELECT DISTINCT (step - 1)::BIGINT AS step, n1, n2, {r6('sim')} AS sim, size FROM w WHERE step > 0"
SQL["cluster_flat"] = f"""{_clusters('>= 0.3')}, last AS (SELECT slot, unnest(members) AS pos FROM w WHERE step = (SELECT max(step) FROM w)),
low AS (SELECT slot, dense_rank() OVER (ORDER BY min(pos)) AS label FROM last GROUP BY 1)
SELECT vec_id::BIGINT AS item, label::BIGINT AS label FROM last JOIN low USING (slot) JOIN v USING (pos)"""

# -- signals and metrics

_SAMPLES = """d AS (SELECT user_id % 8 AS station, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS channel, event_id, value / 500 AS v, regexp_extract(props, '([0-9]+)', 1)::DOUBLE / 100 AS k FROM events),
s AS (SELECT station, channel, row_number() OVER (PARTITION BY station, channel ORDER BY event_id) - 1 AS t, v AS xr, k AS xi, v - k AS yr, v * k AS yi FROM d)"""
_SUMS = ", ".join(f"{r6(f'sum(a.{p}r * b.{q}r + a.{p}i * b.{q}i)')} AS {p}{q}_re, {r6(f'sum(a.{p}i * b.{q}r - a.{p}r * b.{q}i)')} AS {p}{q}_im" for p in "xy" for q in "xy")
SQL["radio_visibility"] = f"WITH {_SAMPLES} SELECT a.station AS i, b.station AS j, a.channel::BIGINT AS channel, {_SUMS} FROM s a JOIN s b ON a.channel = b.channel AND a.t = b.t AND a.station <= b.station GROUP BY 1, 2, 3"
SQL["profile_aggregate"] = "SELECT user_id AS actor, event_type AS op, count(*)::BIGINT AS n, round(sum(value), 4) + 0.0 AS total FROM events GROUP BY 1, 2"

# -- files written and read back

_LETTERS = "chr(10) || upper(regexp_replace(text, '[^A-Za-z]', '', 'g'))"
SQL["fasta_files"] = f"SELECT doc_id, length({_LETTERS})::BIGINT AS letters, md5({_LETTERS}) AS digest FROM documents WHERE doc_id < 60 AND text IS NOT NULL"
SQL["particle_files"] = f"WITH {_POINTS} SELECT particle, {r6('x')} AS x, {r6('y')} AS y, {r6('sigma')} AS sigma FROM pts WHERE particle < 20"
SQL["station_names"] = "SELECT range::VARCHAR AS station FROM range(1500)"
SQL["file_listing"] = "SELECT name, length, (row_number() OVER (ORDER BY name) - 1)::BIGINT AS pos FROM (SELECT n_nationkey || '.txt' AS name, strlen(n_name)::BIGINT AS length FROM nation) WHERE name LIKE '1%'"
SQL["keyed_inputs"] = "SELECT n_regionkey::BIGINT AS key, string_agg(n_name, '+' ORDER BY n_nationkey DESC) AS contents FROM nation GROUP BY 1"
SQL["float_arrays"] = f"SELECT vec_id::BIGINT AS vec_id, (generate_subscripts(embedding, 1) - 1)::BIGINT AS k, {r6('unnest(embedding)::FLOAT::DOUBLE')} AS v FROM embeddings WHERE vec_id < 50"
SQL["matrix_binary"] = f"{_FEW} SELECT i::BIGINT AS i, j::BIGINT AS j, c FROM m"
SQL["distance_json"] = f"{_FEW} SELECT printf('v%03d', i) AS left, printf('v%03d', j) AS right, CASE WHEN i = j THEN -1.0 ELSE c END AS c FROM m"
SQL["linkage_text"] = f"{_clusters('> 0')} SELECT DISTINCT (step - 1)::BIGINT AS step, printf('[%d,%d,%f,%d]', n1, n2, {r6('sim')}, size) AS line FROM w WHERE step > 0"
SQL["flat_cluster_text"] = f"""{_clusters('>= 0.3')}, last AS (SELECT id, list_sort(members) AS members, row_number() OVER (ORDER BY id) AS k FROM w WHERE step = (SELECT max(step) FROM w)),
n AS (SELECT count(*) AS n FROM last), flat AS (SELECT unnest(members) AS pos, k FROM last),
lines AS (SELECT 0 AS pos, 'flat clustering:' AS line UNION ALL SELECT k, id || '=' || members::VARCHAR FROM last
UNION ALL SELECT n + 1, '' FROM n UNION ALL SELECT n + 2, 'labels:' FROM n
UNION ALL SELECT n + 3, '[' || (SELECT string_agg(lpad(k::VARCHAR, length((SELECT n + 1 FROM n)::VARCHAR)::INT, ' ') || ' ', '' ORDER BY pos) FROM flat) || ']' FROM n UNION ALL SELECT n + 4, '' FROM n)
SELECT pos::BIGINT AS pos, line FROM lines"""
SQL["profile_files"] = f"SELECT user_id::VARCHAR AS actor, event_type AS op, count(*)::BIGINT AS n, {r6('sum(floor(abs(value) * 1e6) / 1e9)')} AS total FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2"
SQL["pair_sample"] = "SELECT 200::BIGINT AS n, 200::BIGINT AS different, 200::BIGINT AS ordered"
SQL["emb_dot_tiles"] = SQL["emb_dot_theta"]
SQL["arrivals"] = f"SELECT a.vec_id::BIGINT AS i, b.vec_id::BIGINT AS j, {r6('a.embedding[1]::DOUBLE - 2 * b.embedding[2]::DOUBLE')} AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND b.vec_id < 150"
SQL["cv_sorted"] = _kmers() + f"SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY code) - 1)::BIGINT AS k, code, {r6('val')} AS val FROM v"
SQL["img_ncc"] = _image(_zero_mean("px"), f"SELECT a.img AS i, b.img AS j, {r6('sum(a.v * b.v) / sqrt(sum(a.v * a.v) - sum(a.v) ** 2) / sqrt(sum(b.v * b.v) - sum(b.v) ** 2)')} AS ncc FROM z a JOIN z b ON a.y = b.y AND a.x = b.x AND a.img <= b.img GROUP BY 1, 2")
