"""Geometry queries: the first components of embeddings as vectors, turns and matrices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxelwave.functions import geometry as G
from voxelwave.plans.registry import query
from voxelwave.runtime import cut, table


def vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    g = lambda i: F.get("e", F.lit(i)) * 10
    return e.select("vec_id", G.vec(g(0), g(1), g(2)).alias("a"), G.vec(g(3), g(4), g(5)).alias("b"), g(6).alias("s"))


V = """v AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 10 AS ax, CAST(embedding[2] AS DOUBLE) * 10 AS ay, CAST(embedding[3] AS DOUBLE) * 10 AS az,
CAST(embedding[4] AS DOUBLE) * 10 AS bx, CAST(embedding[5] AS DOUBLE) * 10 AS by_, CAST(embedding[6] AS DOUBLE) * 10 AS bz, CAST(embedding[7] AS DOUBLE) * 10 AS s FROM embeddings)"""
r8 = lambda c: F.round(c, 8) + F.lit(0.0)


def _xyz(c, name):
    return [r8(c[p]).alias(f"{name}_{p}") for p in "xyz"]


def _sql3(name, x, y, z):
    return ", ".join(f"round({e}, 8) + 0.0 AS {name}_{p}" for p, e in zip("xyz", (x, y, z)))


@query("vec3_arithmetic", f"""WITH {V} SELECT vec_id, {_sql3('sum', 'ax + bx', 'ay + by_', 'az + bz')}, {_sql3('scaled', 'ax + s * bx', 'ay + s * by_', 'az + s * bz')},
{_sql3('cross', 'ay * bz - az * by_', 'az * bx - ax * bz', 'ax * by_ - ay * bx')}, {_sql3('lerp', 'ax + (bx - ax) * 0.3', 'ay + (by_ - ay) * 0.3', 'az + (bz - az) * 0.3')},
{_sql3('low', 'least(ax, bx)', 'least(ay, by_)', 'least(az, bz)')}, {_sql3('trunc', 'trunc(ax)', 'trunc(ay)', 'trunc(az)')} FROM v""")
def vec3_arithmetic(spark, sf_dir):
    a, b, s = F.col("a"), F.col("b"), F.col("s")
    return vectors(spark, sf_dir).select("vec_id", *_xyz(G.add(a, b), "sum"), *_xyz(G.add_scaled(a, b, s), "scaled"), *_xyz(G.cross(a, b), "cross"), *_xyz(G.lerp(a, b, 0.3), "lerp"), *_xyz(G.minimum(a, b), "low"), *_xyz(G.round_to_zero(a), "trunc"))


@query("vec3_measures", f"""WITH {V}, m AS (SELECT *, ax * bx + ay * by_ + az * bz AS d, ax * ax + ay * ay + az * az AS aa, bx * bx + by_ * by_ + bz * bz AS bb FROM v)
SELECT vec_id, round(d, 8) + 0.0 AS dot, round(sqrt(aa), 8) + 0.0 AS len, round(abs(ax) + abs(ay) + abs(az), 8) + 0.0 AS manhattan, round(acos(greatest(-1, least(1, d / sqrt(aa * bb)))), 8) + 0.0 AS angle,
round(sqrt(pow(ax - bx, 2) + pow(ay - by_, 2) + pow(az - bz, 2)), 8) + 0.0 AS distance, {_sql3('proj', 'bx * d / bb', 'by_ * d / bb', 'bz * d / bb')},
{_sql3('refl', 'ax - 2 * d * bx', 'ay - 2 * d * by_', 'az - 2 * d * bz')}, {_sql3('unit', 'ax / sqrt(aa)', 'ay / sqrt(aa)', 'az / sqrt(aa)')} FROM m""")
def vec3_measures(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return vectors(spark, sf_dir).select("vec_id", r8(G.dot(a, b)).alias("dot"), r8(G.length(a)).alias("len"), r8(G.length_manhattan(a)).alias("manhattan"), r8(G.angle_to(a, b)).alias("angle"), r8(G.distance_to(a, b)).alias("distance"), *_xyz(G.project_on_vector(a, b), "proj"), *_xyz(G.reflect(a, b), "refl"), *_xyz(G.normalize(a), "unit"))


@query("mat4_apply", f"""WITH {V} SELECT vec_id, {_sql3('moved', 'cos(s) * ax - sin(s) * ay + 1', 'sin(s) * ax + cos(s) * ay + 2', 'az + 3')}, {_sql3('back', 'ax', 'ay', 'az')}, 1.0 AS det FROM v""")
def mat4_apply(spark, sf_dir):
    m = G.m_multiply(G.m_translation(1.0, 2.0, 3.0), G.m_rotation("z", F.col("s")))
    d = vectors(spark, sf_dir).withColumn("m", m).withColumn("p", G.apply_matrix4(F.col("a"), F.col("m")))
    back = G.apply_matrix4(F.col("p"), G.m_invert(F.col("m")))
    return d.select("vec_id", *_xyz(F.col("p"), "moved"), *_xyz(back, "back"), r8(G.m_determinant(F.col("m"))).alias("det"))


@query("quaternion_rotate", f"""WITH {V} SELECT vec_id, {_sql3('turned', 'cos(s) * ax + sin(s) * az', 'ay', '-sin(s) * ax + cos(s) * az')}, {_sql3('undone', 'ax', 'ay', 'az')} FROM v""")
def quaternion_rotate(spark, sf_dir):
    axis = G.vec(0.0, 1.0, 0.0)
    d = vectors(spark, sf_dir).withColumn("q", G.q_from_rotation_matrix(G.m_rotation_axis(axis, F.col("s")))).withColumn("p", G.apply_quaternion(F.col("a"), F.col("q")))
    return d.select("vec_id", *_xyz(F.col("p"), "turned"), *_xyz(G.apply_quaternion(F.col("p"), G.q_invert(F.col("q"))), "undone"))


@query("quaternion_slerp", f"""WITH {V}, w AS (SELECT vec_id, s, cos((s - 0.5) / 2) AS c FROM v), m AS (SELECT vec_id, s, c, CASE WHEN c < 0 THEN -1 ELSE 1 END AS g, acos(least(1, abs(c))) AS h FROM w)
SELECT vec_id, round(CASE WHEN h < 1e-7 THEN sin(s / 2) ELSE (sin(s / 2) + g * sin(0.25)) * sin(h / 2) / sin(h) END, 6) + 0.0 AS x, round(CASE WHEN h < 1e-7 THEN cos(s / 2) ELSE (cos(s / 2) + g * cos(0.25)) * sin(h / 2) / sin(h) END, 6) + 0.0 AS w, round(2 * h, 6) + 0.0 AS angle FROM m""")
def quaternion_slerp(spark, sf_dir):
    """Half way from any turn about x to a fixed one, along the short arc."""
    x = G.vec(1.0, 0.0, 0.0)
    d = vectors(spark, sf_dir).withColumn("p", G.q_from_axis_angle(x, F.col("s"))).withColumn("q", G.q_from_axis_angle(x, 0.5))
    m = G.q_slerp(F.col("p"), F.col("q"), 0.5)
    six = lambda c: F.round(c, 6) + F.lit(0.0)
    return d.select("vec_id", six(m["x"]).alias("x"), six(m["w"]).alias("w"), six(G.q_angle_to(F.col("p"), F.col("q"))).alias("angle"))


# ---------------------------------------------------------------- one row an operation and component


def _rows(name: str, prepared: str, ops: dict[str, tuple], columns: tuple[dict[str, Callable[[], Column]], ...] = ()) -> None:
    """Query ``name``: (vec_id, op, k, value). ``ops`` has a function of the table's columns and the SQL of its components.

    ``columns`` are made first, level by level, and written, so that expressions over them stay small.
    """
    sql = " UNION ALL ".join(f"SELECT vec_id, '{op}' AS op, CAST(unnest(range(0, {len(e)})) AS INTEGER) AS k, round(unnest([{', '.join(f'CAST({x} AS DOUBLE)' for x in e)}]), 6) + 0.0 AS value FROM m" for op, (_, e) in ops.items())

    @query(name, f"WITH {V}, m AS ({prepared}) {sql}")
    def run(spark, sf_dir):
        d = vectors(spark, sf_dir)
        for level in columns:
            d = cut(d.withColumns({c: f() for c, f in level.items()}), "columns")
        parts = F.array(*(F.struct(F.lit(op).alias("op"), f().alias("v")) for op, (f, _) in ops.items()))
        return d.select("vec_id", F.explode(parts).alias("r")).select("vec_id", "r.op", F.posexplode("r.v").alias("k", "value")).select("vec_id", "op", "k", (F.round("value", 6) + F.lit(0.0)).alias("value"))


# columns of ``vectors``, made when a session is there
_a, _b, _s = (lambda: F.col("a")), (lambda: F.col("b")), (lambda: F.col("s"))
_xyz_of = lambda f: lambda: G.to_array(f())
_four = lambda f: lambda: F.array(*(f()[p] for p in G.PARTS))
_one = lambda f: lambda: F.array(f())
_UNIT = "SELECT *, ax * bx + ay * by_ + az * bz AS d, sqrt(ax * ax + ay * ay + az * az) AS la, sqrt(bx * bx + by_ * by_ + bz * bz) AS lb, sqrt(ax * ax + ay * ay + az * az + s * s) AS lp, sqrt(bx * bx + by_ * by_ + bz * bz + 1) AS lq FROM v"

_rows("vec3_components", _UNIT, {
    "splat": (_xyz_of(lambda: G.splat(_s())), ("s", "s", "s")),
    "set_component": (_xyz_of(lambda: G.set_component(_a(), "y", _s())), ("ax", "s", "az")),
    "from_array": (_xyz_of(lambda: G.from_array(G.to_array(_a()))), ("ax", "ay", "az")),
    "add_scalar": (_xyz_of(lambda: G.add_scalar(_a(), _s())), ("ax + s", "ay + s", "az + s")),
    "sub_scalar": (_xyz_of(lambda: G.sub_scalar(_a(), _s())), ("ax - s", "ay - s", "az - s")),
    "sub": (_xyz_of(lambda: G.sub(_a(), _b())), ("ax - bx", "ay - by_", "az - bz")),
    "multiply": (_xyz_of(lambda: G.multiply(_a(), _b())), ("ax * bx", "ay * by_", "az * bz")),
    "multiply_scalar": (_xyz_of(lambda: G.multiply_scalar(_a(), _s())), ("ax * s", "ay * s", "az * s")),
    "divide": (_xyz_of(lambda: G.divide(_a(), G.add_scalar(G.multiply(_b(), _b()), 1.0))), ("ax / (bx * bx + 1)", "ay / (by_ * by_ + 1)", "az / (bz * bz + 1)")),
    "divide_scalar": (_xyz_of(lambda: G.divide_scalar(_a(), _s() * _s() + 1)), ("ax / (s * s + 1)", "ay / (s * s + 1)", "az / (s * s + 1)")),
    "maximum": (_xyz_of(lambda: G.maximum(_a(), _b())), ("greatest(ax, bx)", "greatest(ay, by_)", "greatest(az, bz)")),
    "clamp": (_xyz_of(lambda: G.clamp(_a(), G.splat(-1.0), G.splat(0.5))), tuple(f"greatest(-1, least(0.5, {c}))" for c in ("ax", "ay", "az"))),
    "floor": (_xyz_of(lambda: G.floor(_a())), ("floor(ax)", "floor(ay)", "floor(az)")),
    "ceil": (_xyz_of(lambda: G.ceil(_a())), ("ceil(ax)", "ceil(ay)", "ceil(az)")),
    "rint": (_xyz_of(lambda: G.rint(_a())), ("round_even(ax, 0)", "round_even(ay, 0)", "round_even(az, 0)")),
    "negate": (_xyz_of(lambda: G.negate(_a())), ("-ax", "-ay", "-az")),
    "set_length": (_xyz_of(lambda: G.set_length(_a(), 2.5)), ("ax / la * 2.5", "ay / la * 2.5", "az / la * 2.5")),
    "length_squared": (_one(lambda: G.length_squared(_a())), ("la * la",)),
    "distance_squared": (_one(lambda: G.distance_to_squared(_a(), _b())), ("pow(ax - bx, 2) + pow(ay - by_, 2) + pow(az - bz, 2)",)),
    "distance_manhattan": (_one(lambda: G.distance_to_manhattan(_a(), _b())), ("abs(ax - bx) + abs(ay - by_) + abs(az - bz)",)),
    "same": (_one(lambda: G.same(_a(), _a()).cast("double") + G.same(_a(), G.add_scalar(_a(), 1.0)).cast("double")), ("1",)),
})

_MATRICES = ({
    "rz": lambda: G.m_rotation("z", _s()), "sc": lambda: G.m_scaling(2.0, 3.0, 4.0), "rx": lambda: G.m_rotation("x", _s()), "ta": lambda: G.m_translation(_a()["x"], _a()["y"], _a()["z"]),
    "tb": lambda: G.m_translation(_b()["x"], _b()["y"], _b()["z"]), "t12": lambda: G.m_translation(1.0, 2.0, _s()), "t123": lambda: G.m_translation(1.0, 2.0, 3.0),
}, {"turned": lambda: G.m_multiply(F.col("rz"), F.col("sc"))}, {"both": lambda: G.m_multiply(F.col("t123"), F.col("turned")), "put": lambda: G.m_set_position(F.col("turned"), _a())})
_TURNED = lambda: F.col("turned")
_rows("vec3_transforms", _UNIT, {
    "matrix3": (_xyz_of(lambda: G.apply_matrix3(_a(), F.array(*(F.lit(float(k)) for k in range(1, 10))))), ("ax + 4 * ay + 7 * az", "2 * ax + 5 * ay + 8 * az", "3 * ax + 6 * ay + 9 * az")),
    "direction": (_xyz_of(lambda: G.transform_direction(_a(), F.col("rx"))), ("ax / la", "(cos(s) * ay - sin(s) * az) / la", "(sin(s) * ay + cos(s) * az) / la")),
    "axis_angle": (_xyz_of(lambda: G.apply_axis_angle(_a(), G.vec(0.0, 0.0, 1.0), _s())), ("cos(s) * ax - sin(s) * ay", "sin(s) * ax + cos(s) * ay", "az")),
    "plane": (_xyz_of(lambda: G.project_on_plane(_a(), _b())), ("ax - bx * d / (lb * lb)", "ay - by_ * d / (lb * lb)", "az - bz * d / (lb * lb)")),
    "position": (_xyz_of(lambda: G.from_matrix_position(F.col("ta"))), ("ax", "ay", "az")),
    "column": (_xyz_of(lambda: G.from_matrix_column(_TURNED(), 0)), ("2 * cos(s)", "2 * sin(s)", "0")),
    "scale": (_xyz_of(lambda: G.from_matrix_scale(_TURNED())), ("2", "3", "4")),
    "spherical": (_xyz_of(lambda: G.from_spherical(2.0, _s(), 0.7)), ("2 * sin(s) * sin(0.7)", "2 * cos(s)", "2 * sin(s) * cos(0.7)")),
    "max_scale": (_one(lambda: G.m_max_scale(_TURNED())), ("4",)),
}, _MATRICES)


def _columns(rows: str) -> tuple[str, ...]:
    """Elements by columns of a matrix written by rows."""
    r = [x.strip() for x in rows.split(";")]
    return tuple(r[4 * i + c] for c in range(4) for i in range(4))


_LOOK = f"SELECT *, zx / zl AS wx, zy / zl AS wy, zz / zl AS wz FROM (SELECT *, ax - bx AS zx, ay - by_ AS zy, az - bz AS zz, sqrt(pow(ax - bx, 2) + pow(ay - by_, 2) + pow(az - bz, 2)) AS zl FROM ({_UNIT}))"
_C, _Z = "(1 - cos(s))", "sin(s)"
_rows("mat4_elements", f"SELECT *, sqrt(wz * wz + wx * wx) AS ul FROM ({_LOOK})", {
    "identity": (lambda: G.m_identity(), _columns("1;0;0;0; 0;1;0;0; 0;0;1;0; 0;0;0;1")),
    "set": (lambda: G.m_set([_a()["x"], _a()["y"], _a()["z"], 1.0, _b()["x"], _b()["y"], _b()["z"], 2.0, _s(), 3.0, 4.0, 5.0, 0.0, 0.0, 0.0, 1.0]), _columns("ax;ay;az;1; bx;by_;bz;2; s;3;4;5; 0;0;0;1")),
    "transpose": (lambda: G.m_transpose(_TURNED()), _columns(f"2*cos(s);2*{_Z};0;0; -3*{_Z};3*cos(s);0;0; 0;0;4;0; 0;0;0;1")),
    "times": (lambda: G.m_multiply_scalar(_TURNED(), _s()), _columns(f"s*2*cos(s);-s*3*{_Z};0;0; s*2*{_Z};s*3*cos(s);0;0; 0;0;s*4;0; 0;0;0;s")),
    "premultiply": (lambda: G.m_premultiply(_TURNED(), F.col("t12")), _columns(f"2*cos(s);-3*{_Z};0;1; 2*{_Z};3*cos(s);0;2; 0;0;4;s; 0;0;0;1")),
    "inverse": (lambda: G.m_invert(F.col("both")), _columns(f"cos(s)/2;{_Z}/2;0;-(cos(s)+2*{_Z})/2; -{_Z}/3;cos(s)/3;0;({_Z}-2*cos(s))/3; 0;0;0.25;-0.75; 0;0;0;1")),
    "set_position": (lambda: G.m_set_position(_TURNED(), _a()), _columns(f"2*cos(s);-3*{_Z};0;ax; 2*{_Z};3*cos(s);0;ay; 0;0;4;az; 0;0;0;1")),
    "copy_position": (lambda: G.m_copy_position(_TURNED(), F.col("tb")), _columns(f"2*cos(s);-3*{_Z};0;bx; 2*{_Z};3*cos(s);0;by_; 0;0;4;bz; 0;0;0;1")),
    "basis": (lambda: G.m_basis(_a(), _b(), G.splat(_s())), _columns("ax;bx;s;0; ay;by_;s;0; az;bz;s;0; 0;0;0;1")),
    "rotation": (lambda: G.m_extract_rotation(_TURNED()), _columns(f"cos(s);-{_Z};0;0; {_Z};cos(s);0;0; 0;0;1;0; 0;0;0;1")),
    "scaled": (lambda: G.m_scale(F.col("rz"), G.vec(2.0, 3.0, 4.0)), _columns(f"2*cos(s);-3*{_Z};0;0; 2*{_Z};3*cos(s);0;0; 0;0;4;0; 0;0;0;1")),
    "rotation_x": (lambda: G.m_rotation("x", _s()), _columns(f"1;0;0;0; 0;cos(s);-{_Z};0; 0;{_Z};cos(s);0; 0;0;0;1")),
    "rotation_y": (lambda: G.m_rotation("y", _s()), _columns(f"cos(s);0;{_Z};0; 0;1;0;0; -{_Z};0;cos(s);0; 0;0;0;1")),
    "rotation_axis": (lambda: G.m_rotation_axis(G.vec(1 / 3, 2 / 3, 2 / 3), _s()), _columns(
        f"{_C}/9+cos(s);{_C}*2/9-{_Z}*2/3;{_C}*2/9+{_Z}*2/3;0; {_C}*2/9+{_Z}*2/3;{_C}*4/9+cos(s);{_C}*4/9-{_Z}/3;0; {_C}*2/9-{_Z}*2/3;{_C}*4/9+{_Z}/3;{_C}*4/9+cos(s);0; 0;0;0;1")),
    "shear": (lambda: G.m_shear(1.0, 2.0, 3.0, 4.0, 5.0, _s()), _columns("1;3;5;0; 1;1;s;0; 2;4;1;0; 0;0;0;1")),
    "perspective": (lambda: G.m_perspective(-1.0, 3.0, 2.0, -2.0, 1.0, 9.0), _columns("0.5;0;0.5;0; 0;0.5;0;0; 0;0;-1.25;-2.25; 0;0;-1;0")),
    "orthographic": (lambda: G.m_orthographic(-1.0, 3.0, 2.0, -2.0, 1.0, 9.0), _columns("0.5;0;0;-0.5; 0;0.5;0;0; 0;0;-0.25;-1.25; 0;0;0;1")),
    "look_at": (lambda: G.m_look_at(_a(), _b(), G.vec(0.0, 1.0, 0.0)), _columns("wz/ul;wy*(-wx)/ul;wx;0; 0;(wz*wz+wx*wx)/ul;wy;0; -wx/ul;-wy*wz/ul;wz;0; 0;0;0;1")),
    "ras_lps": (lambda: G.ras_lps(F.col("put")), _columns(f"2*cos(s);-3*{_Z};0;-ax; 2*{_Z};3*cos(s);0;-ay; 0;0;4;az; 0;0;0;1")),
}, _MATRICES)

_TURNS = ({
    "p": lambda: G.q_normalize(G.quat(_a()["x"], _a()["y"], _a()["z"], _s())), "q": lambda: G.q_normalize(G.quat(_b()["x"], _b()["y"], _b()["z"], 1.0)),
    "ua": lambda: G.normalize(_a()), "ub": lambda: G.normalize(_b()), "none": lambda: G.q_from_axis_angle(G.vec(1.0, 0.0, 0.0), 0.0), "two": lambda: G.q_from_axis_angle(G.vec(1.0, 0.0, 0.0), 2.0),
}, {
    "pq": lambda: G.q_multiply(F.col("p"), F.col("q")), "qp": lambda: G.q_premultiply(F.col("p"), F.col("q")), "uv": lambda: G.q_from_unit_vectors(F.col("ua"), F.col("ub")), "near": lambda: G.q_rotate_towards(F.col("none"), F.col("two"), 0.5),
})
_P, _Q = (lambda: F.col("p")), (lambda: F.col("q"))
_NORMAL = f"SELECT *, ax / lp AS px, ay / lp AS py, az / lp AS pz, s / lp AS pw, bx / lq AS qx, by_ / lq AS qy, bz / lq AS qz, 1 / lq AS qw, ax / la AS ux, ay / la AS uy, az / la AS uz, bx / lb AS tx, by_ / lb AS ty, bz / lb AS tz FROM ({_UNIT})"
_HAMILTON = lambda p, q: (f"{p}w*{q}x + {p}x*{q}w + {p}y*{q}z - {p}z*{q}y", f"{p}w*{q}y + {p}y*{q}w + {p}z*{q}x - {p}x*{q}z", f"{p}w*{q}z + {p}z*{q}w + {p}x*{q}y - {p}y*{q}x", f"{p}w*{q}w - {p}x*{q}x - {p}y*{q}y - {p}z*{q}z")
_rows("quaternion_algebra", f"SELECT *, px * qx + py * qy + pz * qz + pw * qw AS pq, sqrt(2 * (1 + ux * tx + uy * ty + uz * tz)) AS h FROM ({_NORMAL})", {
    "identity": (_four(lambda: G.q_identity()), ("0", "0", "0", "1")),
    "normalize": (_four(_P), ("px", "py", "pz", "pw")),
    "conjugate": (_four(lambda: G.q_conjugate(_P())), ("-px", "-py", "-pz", "pw")),
    "multiply": (_four(lambda: F.col("pq")), _HAMILTON("p", "q")),
    "premultiply": (_four(lambda: F.col("qp")), _HAMILTON("q", "p")),
    "dot": (_one(lambda: G.q_dot(_P(), _Q())), ("pq",)),
    "length": (_one(lambda: G.q_length(G.quat(_a()["x"], _a()["y"], _a()["z"], _s()))), ("lp",)),
    "angle": (_one(lambda: G.q_angle_to(_P(), _Q())), ("2 * acos(least(1, abs(pq)))",)),
    "unit_vectors": (_four(lambda: F.col("uv")), ("(uy * tz - uz * ty) / h", "(uz * tx - ux * tz) / h", "(ux * ty - uy * tx) / h", "h / 2")),
    "axis_angle": (_four(lambda: G.q_from_axis_angle(G.vec(0.0, 0.6, 0.8), _s())), ("0", "0.6 * sin(s / 2)", "0.8 * sin(s / 2)", "cos(s / 2)")),
    "towards": (_four(lambda: F.col("near")), ("sin(0.25)", "0", "0", "cos(0.25)")),
}, _TURNS)
