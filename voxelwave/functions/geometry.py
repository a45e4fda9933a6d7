"""Vectors, 4x4 matrices and quaternions as pure column functions.

A vector is struct<x,y,z>, a quaternion struct<x,y,z,w>, a matrix array<double> of 16 values by column. Nothing is mutated:
each function returns a new column, so rows of any number are handled by whole-stage code, and an operand of size one is a
literal or a broadcast row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def lit(v: float | Column) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def _let(value: Column, made) -> Column:
    """``made`` of a value that it uses several times; the value stands in the expression once."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


# ---------------------------------------------------------------- vectors


def vec(x, y, z) -> Column:
    return F.struct(lit(x).alias("x"), lit(y).alias("y"), lit(z).alias("z"))


def _each(f, *vs: Column) -> Column:
    return vec(*(f(*(v[a] for v in vs)) for a in AXES))


def splat(value) -> Column:
    return vec(value, value, value)


def set_component(v: Column, axis: str, value) -> Column:
    return vec(*(lit(value) if a == axis else v[a] for a in AXES))


def from_array(a: Column) -> Column:
    return vec(F.get(a, F.lit(0)), F.get(a, F.lit(1)), F.get(a, F.lit(2)))


def to_array(v: Column) -> Column:
    return F.array(*(v[a] for a in AXES))


def add(a: Column, b: Column) -> Column:
    return _each(lambda p, q: p + q, a, b)


def add_scalar(v: Column, s) -> Column:
    return _each(lambda p: p + lit(s), v)


def add_scaled(a: Column, b: Column, s) -> Column:
    return _each(lambda p, q: p + q * lit(s), a, b)


def sub(a: Column, b: Column) -> Column:
    return _each(lambda p, q: p - q, a, b)


def sub_scalar(v: Column, s) -> Column:
    return _each(lambda p: p - lit(s), v)


def multiply(a: Column, b: Column) -> Column:
    return _each(lambda p, q: p * q, a, b)


def multiply_scalar(v: Column, s) -> Column:
    return _each(lambda p: p * lit(s), v)


def divide(a: Column, b: Column) -> Column:
    return _each(F.try_divide, a, b)


def divide_scalar(v: Column, s) -> Column:
    return _each(lambda p: F.try_divide(p, lit(s)), v)


def minimum(a: Column, b: Column) -> Column:
    return _each(F.least, a, b)


def maximum(a: Column, b: Column) -> Column:
    return _each(F.greatest, a, b)


def clamp(v: Column, low: Column, high: Column) -> Column:
    return _each(lambda p, lo, hi: F.greatest(lo, F.least(hi, p)), v, low, high)


def floor(v: Column) -> Column:
    return _each(lambda p: F.floor(p).cast("double"), v)


def ceil(v: Column) -> Column:
    return _each(lambda p: F.ceil(p).cast("double"), v)


def rint(v: Column) -> Column:
    """Halves go to the even neighbour."""
    return _each(lambda p: F.rint(p) + F.lit(0.0), v)


def round_to_zero(v: Column) -> Column:
    return _each(lambda p: F.when(p < 0, F.ceil(p)).otherwise(F.floor(p)).cast("double"), v)


def negate(v: Column) -> Column:
    return _each(lambda p: -p, v)


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def length_squared(v: Column) -> Column:
    return dot(v, v)


def length(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def length_manhattan(v: Column) -> Column:
    return F.abs(v["x"]) + F.abs(v["y"]) + F.abs(v["z"])


def normalize(v: Column) -> Column:
    """A vector of no length stays as it is."""
    n = length(v)
    return _each(lambda p: F.when((n > 0) & ~F.isnan(n), F.try_divide(p, n)).otherwise(p), v)


def set_length(v: Column, n) -> Column:
    return multiply_scalar(normalize(v), n)


def lerp(a: Column, b: Column, t) -> Column:
    return _each(lambda p, q: p + (q - p) * lit(t), a, b)


def cross(a: Column, b: Column) -> Column:
    return vec(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def apply_matrix3(v: Column, m: Column) -> Column:
    e = lambda i: F.get(m, F.lit(i))
    return vec(*(e(r) * v["x"] + e(r + 3) * v["y"] + e(r + 6) * v["z"] for r in range(3)))


def apply_matrix4(v: Column, m: Column) -> Column:
    """With the perspective division."""
    row = lambda r: at(m, r, 0) * v["x"] + at(m, r, 1) * v["y"] + at(m, r, 2) * v["z"] + at(m, r, 3)
    w = row(3)
    return vec(*(F.try_divide(row(r), w) for r in range(3)))


def transform_direction(v: Column, m: Column) -> Column:
    return normalize(vec(*(at(m, r, 0) * v["x"] + at(m, r, 1) * v["y"] + at(m, r, 2) * v["z"] for r in range(3))))


def apply_quaternion(v: Column, q: Column) -> Column:
    """v + 2 w (u x v) + 2 u x (u x v), with u the vector part."""
    t = multiply_scalar(cross(q, v), 2.0)
    return add(add(v, multiply_scalar(t, q["w"])), cross(q, t))


def apply_axis_angle(v: Column, axis: Column, angle) -> Column:
    return apply_quaternion(v, q_from_axis_angle(axis, angle))


def project_on_vector(v: Column, onto: Column) -> Column:
    d = length_squared(onto)
    return multiply_scalar(onto, F.when(d == 0, 0.0).otherwise(F.try_divide(dot(v, onto), d)))


def project_on_plane(v: Column, normal: Column) -> Column:
    return sub(v, project_on_vector(v, normal))


def reflect(v: Column, normal: Column) -> Column:
    return sub(v, multiply_scalar(normal, 2 * dot(v, normal)))


def angle_to(a: Column, b: Column) -> Column:
    d = F.sqrt(length_squared(a) * length_squared(b))
    return F.when(d == 0, F.pi() / 2).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot(a, b), d)))))


def distance_to(a: Column, b: Column) -> Column:
    return length(sub(a, b))


def distance_to_squared(a: Column, b: Column) -> Column:
    return length_squared(sub(a, b))


def distance_to_manhattan(a: Column, b: Column) -> Column:
    return length_manhattan(sub(a, b))


def from_matrix_position(m: Column) -> Column:
    return vec(*(at(m, r, 3) for r in range(3)))


def from_matrix_column(m: Column, c: int) -> Column:
    return vec(*(at(m, r, c) for r in range(3)))


def from_matrix_scale(m: Column) -> Column:
    return vec(*(length(from_matrix_column(m, c)) for c in range(3)))


def from_spherical(radius, phi, theta) -> Column:
    r, p, t = lit(radius), lit(phi), lit(theta)
    return vec(r * F.sin(p) * F.sin(t), r * F.cos(p), r * F.sin(p) * F.cos(t))


# ---------------------------------------------------------------- matrices


def at(m: Column, row: int, col: int) -> Column:
    return F.get(m, F.lit(4 * col + row))


def matrix(rows) -> Column:
    """From four rows of four values or columns."""
    return F.array(*(lit(rows[r][c]) for c in range(4) for r in range(4)))


def m_identity() -> Column:
    return matrix([[float(r == c) for c in range(4)] for r in range(4)])


def m_set(values, byrow: bool = True) -> Column:
    return matrix([[values[4 * r + c] if byrow else values[4 * c + r] for c in range(4)] for r in range(4)])


def m_multiply(a: Column, b: Column) -> Column:
    return _let(a, lambda p: _let(b, lambda q: _product(p, q)))


def _product(a: Column, b: Column) -> Column:
    return matrix([[sum((at(a, r, k) * at(b, k, c) for k in range(1, 4)), at(a, r, 0) * at(b, 0, c)) for c in range(4)] for r in range(4)])


def m_premultiply(a: Column, b: Column) -> Column:
    return m_multiply(b, a)


def m_multiply_scalar(m: Column, s) -> Column:
    return F.transform(m, lambda v: v * lit(s))


def m_transpose(m: Column) -> Column:
    return matrix([[at(m, c, r) for c in range(4)] for r in range(4)])


def _minor(m: Column, rows: tuple[int, ...], cols: tuple[int, ...]) -> Column:
    if len(rows) == 1:
        return at(m, rows[0], cols[0])
    out = None
    for k, c in enumerate(cols):
        term = at(m, rows[0], c) * _minor(m, rows[1:], cols[:k] + cols[k + 1 :])
        out = term if out is None else (out - term if k % 2 else out + term)
    return out


def m_determinant(m: Column) -> Column:
    return _minor(m, (0, 1, 2, 3), (0, 1, 2, 3))


def m_invert(m: Column) -> Column:
    """Adjugate over determinant; zeros where the determinant is zero."""
    rest = lambda k: tuple(i for i in range(4) if i != k)

    def made(e: Column) -> Column:
        adjugate = F.array(*((-1.0) ** (r + c) * _minor(e, rest(c), rest(r)) for c in range(4) for r in range(4)))
        return _let(m_determinant(e), lambda det: F.transform(adjugate, lambda v: F.when(det == 0, 0.0).otherwise(F.try_divide(v, det))))

    return _let(m, made)


def m_copy_position(m: Column, source: Column) -> Column:
    return matrix([[at(source if c == 3 and r < 3 else m, r, c) for c in range(4)] for r in range(4)])


def m_set_position(m: Column, v: Column) -> Column:
    return matrix([[v[AXES[r]] if c == 3 and r < 3 else at(m, r, c) for c in range(4)] for r in range(4)])


def m_basis(x: Column, y: Column, z: Column) -> Column:
    return matrix([[v[a] for v in (x, y, z)] + [0.0] for a in AXES] + [[0.0, 0.0, 0.0, 1.0]])


def m_extract_basis(m: Column) -> tuple[Column, Column, Column]:
    return tuple(from_matrix_column(m, c) for c in range(3))


def m_extract_rotation(m: Column) -> Column:
    return _let(m, lambda e: m_basis(*(divide_scalar(v, length(v)) for v in m_extract_basis(e))))


def m_look_at(eye: Column, target: Column, up: Column) -> Column:
    """z from target to eye, x = up x z; a view along ``up`` or onto itself is nudged."""
    def from_view(u: Column, d: Column) -> Column:
        z = _let(vec(d["x"], d["y"], F.when(length_squared(d) == 0, 1.0).otherwise(d["z"])), normalize)
        return _let(z, lambda v: _let(nudged(u, v), normalize))

    def nudged(u: Column, z: Column) -> Column:
        along = length_squared(cross(u, z)) == 0
        return vec(z["x"] + F.when(along & (F.abs(u["z"]) == 1), 1e-4).otherwise(0.0), z["y"], z["z"] + F.when(along & (F.abs(u["z"]) != 1), 1e-4).otherwise(0.0))

    def frame(u: Column, z: Column) -> Column:
        return _let(_let(cross(u, z), normalize), lambda x: m_basis(x, cross(z, x), z))

    return _let(up, lambda u: _let(_let(sub(eye, target), lambda d: from_view(u, d)), lambda z: frame(u, z)))


def m_scale(m: Column, v: Column) -> Column:
    return matrix([[at(m, r, c) * v[AXES[c]] if c < 3 else at(m, r, c) for c in range(4)] for r in range(4)])


def m_max_scale(m: Column) -> Column:
    return F.sqrt(F.greatest(*(length_squared(v) for v in m_extract_basis(m))))


def m_translation(x, y, z) -> Column:
    return matrix([[1.0, 0.0, 0.0, x], [0.0, 1.0, 0.0, y], [0.0, 0.0, 1.0, z], [0.0, 0.0, 0.0, 1.0]])


def m_rotation(axis: str, theta) -> Column:
    c, s = F.cos(lit(theta)), F.sin(lit(theta))
    i = AXES.index(axis)
    a, b = (i + 1) % 3, (i + 2) % 3
    rows: list[list] = [[float(r == k) for k in range(4)] for r in range(4)]
    rows[a][a], rows[a][b], rows[b][a], rows[b][b] = c, -s, s, c
    return matrix(rows)


def m_rotation_axis(axis: Column, angle) -> Column:
    """Rodrigues' formula, for a unit axis."""
    c, s = F.cos(lit(angle)), F.sin(lit(angle))
    u = [axis[a] for a in AXES]
    skew = [[None, (-1, 2), (1, 1)], [(1, 2), None, (-1, 0)], [(-1, 1), (1, 0), None]]
    rows = []
    for r in range(3):
        row = []
        for k in range(3):
            v = u[r] * u[k] * (1 - c)
            row.append(v + c if r == k else v + s * u[skew[r][k][1]] * skew[r][k][0])
        rows.append([*row, 0.0])
    return matrix([*rows, [0.0, 0.0, 0.0, 1.0]])


def m_scaling(x, y, z) -> Column:
    return matrix([[x, 0.0, 0.0, 0.0], [0.0, y, 0.0, 0.0], [0.0, 0.0, z, 0.0], [0.0, 0.0, 0.0, 1.0]])


def m_shear(xy, xz, yx, yz, zx, zy) -> Column:
    return matrix([[1.0, yx, zx, 0.0], [xy, 1.0, zy, 0.0], [xz, yz, 1.0, 0.0], [0.0, 0.0, 0.0, 1.0]])


def m_perspective(left, right, top, bottom, near, far) -> Column:
    return matrix([
        [2.0 * near / (right - left), 0.0, (right + left) / (right - left), 0.0],
        [0.0, 2.0 * near / (top - bottom), (top + bottom) / (top - bottom), 0.0],
        [0.0, 0.0, -(far + near) / (far - near), -2.0 * far * near / (far - near)],
        [0.0, 0.0, -1.0, 0.0],
    ])


def m_orthographic(left, right, top, bottom, near, far) -> Column:
    return matrix([
        [2.0 / (right - left), 0.0, 0.0, -(right + left) / (right - left)],
        [0.0, 2.0 / (top - bottom), 0.0, -(top + bottom) / (top - bottom)],
        [0.0, 0.0, -2.0 / (far - near), -(far + near) / (far - near)],
        [0.0, 0.0, 0.0, 1.0],
    ])


# ---------------------------------------------------------------- quaternions

PARTS = ("x", "y", "z", "w")


def quat(x, y, z, w) -> Column:
    return F.struct(*(lit(v).alias(n) for n, v in zip(PARTS, (x, y, z, w))))


def q_identity() -> Column:
    return quat(0.0, 0.0, 0.0, 1.0)


def q_dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"] + a["w"] * b["w"]


def q_length(q: Column) -> Column:
    return F.sqrt(q_dot(q, q))


def q_normalize(q: Column) -> Column:
    n = q_length(q)
    return quat(*(F.when(n == 0, F.lit(float(p == "w"))).otherwise(F.try_divide(q[p], n)) for p in PARTS))


def q_conjugate(q: Column) -> Column:
    return quat(-q["x"], -q["y"], -q["z"], q["w"])


q_invert = q_conjugate


def q_multiply(a: Column, b: Column) -> Column:
    v = add(add(multiply_scalar(b, a["w"]), multiply_scalar(a, b["w"])), cross(a, b))
    return quat(v["x"], v["y"], v["z"], a["w"] * b["w"] - dot(a, b))


def q_premultiply(a: Column, b: Column) -> Column:
    return q_multiply(b, a)


def q_from_axis_angle(axis: Column, angle) -> Column:
    s = F.sin(lit(angle) / 2)
    return quat(axis["x"] * s, axis["y"] * s, axis["z"] * s, F.cos(lit(angle) / 2))


def q_from_rotation_matrix(m: Column, fix_handedness: bool = False) -> Column:
    """The branch with the largest of trace and diagonal keeps the root away from zero."""
    e = [[at(m, r, c) for c in range(3)] for r in range(3)]
    if fix_handedness:
        det = _minor(m, (0, 1, 2), (0, 1, 2))
        for r in range(3):
            e[r][2] = F.when(det < 0, -e[r][2]).otherwise(e[r][2])
    trace = e[0][0] + e[1][1] + e[2][2]
    root = F.sqrt(F.greatest(trace + 1, F.lit(0.0))) * 2
    by_w = quat(F.try_divide(e[2][1] - e[1][2], root), F.try_divide(e[0][2] - e[2][0], root), F.try_divide(e[1][0] - e[0][1], root), root / 4)

    def by_axis(i: int) -> Column:
        j, k = (i + 1) % 3, (i + 2) % 3
        s = F.sqrt(F.greatest(1 + e[i][i] - e[j][j] - e[k][k], F.lit(0.0))) * 2
        part = {AXES[i]: s / 4, AXES[j]: F.try_divide(e[i][j] + e[j][i], s), AXES[k]: F.try_divide(e[i][k] + e[k][i], s)}
        return quat(part["x"], part["y"], part["z"], F.try_divide(e[k][j] - e[j][k], s))

    return F.when(trace > 0, by_w).when((e[0][0] > e[1][1]) & (e[0][0] > e[2][2]), by_axis(0)).when(e[1][1] > e[2][2], by_axis(1)).otherwise(by_axis(2))


def q_from_unit_vectors(a: Column, b: Column) -> Column:
    """The shortest turn from a to b; opposite vectors turn about some axis at right angles."""
    return _let(a, lambda p: _let(b, lambda q: _turn(p, q)))


def _turn(a: Column, b: Column) -> Column:
    r = dot(a, b) + 1
    c = cross(a, b)
    wide = F.abs(a["x"]) > F.abs(a["z"])
    back = quat(F.when(wide, -a["y"]).otherwise(0.0), F.when(wide, a["x"]).otherwise(-a["z"]), F.when(wide, 0.0).otherwise(a["y"]), 0.0)
    return _let(F.when(r < 2.220446049250313e-16, back).otherwise(quat(c["x"], c["y"], c["z"], r)), q_normalize)


def q_angle_to(a: Column, b: Column) -> Column:
    return 2 * F.acos(F.least(F.lit(1.0), F.abs(q_dot(a, b))))


def q_slerp(a: Column, b: Column, t) -> Column:
    """Along the short arc; nearly equal turns are mixed linearly and normalised."""
    return _let(a, lambda p: _let(b, lambda q: _let(lit(t), lambda s: _arc(p, q, s))))


def _arc(a: Column, b: Column, t: Column) -> Column:
    d = q_dot(a, b)
    sign = F.when(d < 0, -1.0).otherwise(1.0)
    cos = F.abs(d)
    sin2 = 1 - cos * cos
    sin = F.sqrt(F.greatest(sin2, F.lit(0.0)))
    half = F.atan2(sin, cos)
    far = quat(*(F.try_divide(a[p] * F.sin((1 - t) * half) + sign * b[p] * F.sin(t * half), sin) for p in PARTS))
    near = q_normalize(quat(*(a[p] * (1 - t) + sign * b[p] * t for p in PARTS)))
    return F.when(cos >= 1, a).when(sin2 <= 2.220446049250313e-16, near).otherwise(far)


def q_rotate_towards(a: Column, b: Column, step) -> Column:
    angle = q_angle_to(a, b)
    return F.when(angle == 0, a).otherwise(q_slerp(a, b, F.least(F.lit(1.0), F.try_divide(lit(step), angle))))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def ras_lps(m: Column) -> Column:
    """The same map in the other of the two conventions: both first axes flip."""
    s = (-1.0, -1.0, 1.0, 1.0)
    return matrix([[at(m, r, c) * (s[r] * s[c]) for c in range(4)] for r in range(4)])
