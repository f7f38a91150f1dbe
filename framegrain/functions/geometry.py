"""Rotations and rigid transforms as column expressions. Vectors and row-major 3x3 matrices are arrays of double.

Quaternions are x, y, z, w. Each function binds its inputs once, so nested expressions stay small.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def together(body, **values: Column) -> Column:
    """body of a struct of the values, each computed once."""
    return bound(F.struct(*[v.alias(n) for n, v in values.items()]), body)


def _items(v: Column, n: int) -> list[Column]:
    return [F.get(v, F.lit(i)) for i in range(n)]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def scaled(v: Column, k: Column) -> Column:
    return F.transform(v, lambda x: x * k)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def cross(a: Column, b: Column) -> Column:
    def three(p: Column) -> Column:
        (a1, a2, a3), (b1, b2, b3) = _items(p["a"], 3), _items(p["b"], 3)
        return F.array(a2 * b3 - a3 * b2, a3 * b1 - a1 * b3, a1 * b2 - a2 * b1)

    return together(three, a=a, b=b)


def unit(v: Column, least: float = 1e-8) -> Column:
    """v over its norm; a norm below `least` fails."""
    checked = lambda n: F.when(n < least, F.raise_error(F.lit("vector has no direction")).cast("double")).otherwise(n)
    return bound(v, lambda x: bound(bound(norm(x), lambda n: 1 / checked(n)), lambda k: scaled(x, k)))


def quaternion_to_matrix(q: Column) -> Column:
    def nine(u: Column) -> Column:
        x, y, z, w = _items(u, 4)
        return F.array(
            1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
            2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
            2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
        )

    return bound(unit(q), nine)


def matrix_to_six(m: Column) -> Column:
    """The first two columns of a rotation matrix."""
    return bound(m, lambda x: F.array(*[F.get(x, F.lit(i)) for i in (0, 3, 6, 1, 4, 7)]))


def six_to_matrix(s: Column, least: float = 1e-8) -> Column:
    """Gram and Schmidt on the two columns; parallel or vanishing columns fail."""
    def second(p: Column) -> Column:
        e1, b = p["e1"], p["b"]
        e2 = bound(dot(e1, b), lambda k: unit(minus(b, scaled(e1, k)), least))
        rows = lambda e: F.array(*[F.get(e[n], F.lit(i)) for i in range(3) for n in ("e1", "e2", "e3")])
        return bound(e2, lambda e2: together(rows, e1=e1, e2=e2, e3=cross(e1, e2)))

    return bound(s, lambda v: together(second, e1=unit(F.slice(v, 1, 3), least), b=F.slice(v, 4, 3)))


def product(a: Column, b: Column) -> Column:
    def both(p: Column) -> Column:
        x, y = _items(p["x"], 9), _items(p["y"], 9)
        return F.array(*[x[3 * i] * y[j] + x[3 * i + 1] * y[3 + j] + x[3 * i + 2] * y[6 + j] for i in range(3) for j in range(3)])

    return bound(F.struct(a.alias("x"), b.alias("y")), both)


def transposed(m: Column) -> Column:
    return bound(m, lambda x: F.array(*[F.get(x, F.lit(i)) for i in (0, 3, 6, 1, 4, 7, 2, 5, 8)]))


def rotate(m: Column, v: Column) -> Column:
    def three(p: Column) -> Column:
        x, y = _items(p["m"], 9), _items(p["v"], 3)
        return F.array(*[F.lit(0.0) + x[3 * i] * y[0] + x[3 * i + 1] * y[1] + x[3 * i + 2] * y[2] for i in range(3)])

    return together(three, m=m, v=v)


def local_delta(p0: Column, r0: Column, p1: Column, r1: Column) -> Column:
    """struct(translation, rotation): the second pose in the first one's frame."""
    return together(lambda s: F.struct(rotate(s["back"], s["step"]).alias("translation"), product(s["back"], s["r1"]).alias("rotation")), back=transposed(r0), step=minus(p1, p0), r1=r1)


def advanced(p: Column, r: Column, delta: Column) -> Column:
    """struct(position, rotation) after a local delta."""
    def both(s: Column) -> Column:
        moved = F.zip_with(s["p"], rotate(s["r"], s["d"]["translation"]), lambda x, y: x + y)
        return F.struct(moved.alias("position"), product(s["r"], s["d"]["rotation"]).alias("rotation"))

    return together(both, p=p, r=r, d=delta)


def matrix_to_euler(m: Column) -> Column:
    """Angles about x, y, z of Rz * Ry * Rx, to full precision also where the second is close to a right angle.

    The turn about z is taken back before the others are read; it is 0 where it can't be told from the one about x.
    """
    def three(v: Column) -> Column:
        i, z = _items(v["m"], 9), F.atan2(F.get(v["m"], F.lit(3)), F.get(v["m"], F.lit(0)))
        c, s = v["c"], v["s"]
        return F.array(F.atan2(s * i[2] - c * i[5], c * i[4] - s * i[1]), F.atan2(-i[6], c * i[0] + s * i[3]), z)

    def turned(v: Column) -> Column:
        z = F.atan2(F.get(v, F.lit(3)), F.get(v, F.lit(0)))
        return F.struct(v.alias("m"), F.cos(z).alias("c"), F.sin(z).alias("s"))

    return bound(bound(m, turned), three)


def euler_to_matrix(e: Column) -> Column:
    def nine(v: Column) -> Column:
        x, y, z = _items(v, 3)
        cx, sx, cy, sy, cz, sz = F.cos(x), F.sin(x), F.cos(y), F.sin(y), F.cos(z), F.sin(z)
        return F.array(cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx, sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx, -sy, cy * sx, cy * cx)

    return bound(e, nine)


def angle_between(a: Column, b: Column) -> Column:
    """Degrees of the rotation from one matrix to the other."""
    trace = lambda m: F.get(m, F.lit(0)) + F.get(m, F.lit(4)) + F.get(m, F.lit(8))
    return bound(product(transposed(a), b), lambda m: F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace(m) - 1) / 2)))))


def matrix_to_quaternion(m: Column) -> Column:
    """The quaternion with w >= 0; where w vanishes, the largest component is positive."""
    def four(v: Column) -> Column:
        i = _items(v, 9)
        w = F.sqrt(F.greatest(F.lit(0.0), 1 + i[0] + i[4] + i[8])) / 2
        x = F.sqrt(F.greatest(F.lit(0.0), 1 + i[0] - i[4] - i[8])) / 2
        y = F.sqrt(F.greatest(F.lit(0.0), 1 - i[0] + i[4] - i[8])) / 2
        z = F.sqrt(F.greatest(F.lit(0.0), 1 - i[0] - i[4] + i[8])) / 2
        # Each is divided by the largest component, so none is the difference of nearly equal numbers over a small one.
        by_w = F.array((i[7] - i[5]) / (4 * w), (i[2] - i[6]) / (4 * w), (i[3] - i[1]) / (4 * w), w)
        by_x = F.array(x, (i[1] + i[3]) / (4 * x), (i[2] + i[6]) / (4 * x), (i[7] - i[5]) / (4 * x))
        by_y = F.array((i[1] + i[3]) / (4 * y), y, (i[5] + i[7]) / (4 * y), (i[2] - i[6]) / (4 * y))
        by_z = F.array((i[2] + i[6]) / (4 * z), (i[5] + i[7]) / (4 * z), z, (i[3] - i[1]) / (4 * z))
        top = F.greatest(w, x, y, z)
        return F.when(w == top, by_w).when(x == top, by_x).when(y == top, by_y).otherwise(by_z)

    def signed(q: Column) -> Column:
        w = F.get(q, F.lit(3))
        vanishes = F.concat(F.slice(q, 1, 3), F.array(F.abs(w)))
        return F.when(w < -1e-12, F.transform(q, lambda c: -c)).when(w < 0, vanishes).otherwise(q)

    return bound(bound(m, four), signed)


def quaternion_distance(a: Column, b: Column) -> Column:
    """Largest difference of a component, to b or to -b."""
    most = lambda p, f: F.array_max(F.zip_with(p["a"], p["b"], f))
    return together(lambda p: F.least(most(p, lambda x, y: F.abs(x - y)), most(p, lambda x, y: F.abs(x + y))), a=a, b=b)


def clipped(v: Column, limit: float = 1.0) -> Column:
    return F.transform(v, lambda x: F.greatest(F.lit(-limit), F.least(F.lit(limit), x)))


def encode_action(delta: Column, gripper: Column, t_scale: float, r_scale: float, g_scale: float, six: bool = False) -> Column:
    """Translation and rotation of a delta and an absolute gripper to one vector: 7 channels, or 10 with six rotation ones."""
    grip = F.greatest(F.lit(0.0), F.least(F.lit(1.0), gripper / g_scale))

    def channels(d: Column) -> Column:
        rotation = matrix_to_six(d["rotation"]) if six else clipped(scaled(matrix_to_euler(d["rotation"]), F.lit(1 / r_scale)))
        return F.concat(clipped(scaled(d["translation"], F.lit(1 / t_scale))), rotation, F.array(grip))

    return bound(delta, channels)


def decode_action(action: Column, t_scale: float, r_scale: float, g_scale: float, six: bool = False) -> Column:
    """struct(translation, rotation, gripper); the inverse of encode_action where nothing was clipped."""
    def parts(a: Column) -> Column:
        rotation = six_to_matrix(F.slice(a, 4, 6)) if six else euler_to_matrix(scaled(F.slice(a, 4, 3), F.lit(r_scale)))
        return F.struct(scaled(F.slice(a, 1, 3), F.lit(t_scale)).alias("translation"), rotation.alias("rotation"), (F.element_at(a, -1) * g_scale).alias("gripper"))

    return bound(action, parts)


def integrate(p: Column, r: Column, deltas: Column) -> Column:
    """All poses that a start pose and an ordered array of local deltas give, the start first."""
    start = F.array(F.struct(p.alias("position"), r.alias("rotation")))
    return F.aggregate(deltas, start, lambda a, d: bound(F.element_at(a, -1), lambda last: F.concat(a, F.array(advanced(last["position"], last["rotation"], d)))))


def close_to(a: Column, b: Column, atol: float) -> Column:
    return norm(minus(a, b)) < atol


def horizons(errors: Column, at=(1, 4, 8, 16)) -> Column:
    """Means of the first h errors of a chunk, for each h."""
    mean = lambda h: F.aggregate(F.slice(errors, 1, h), F.lit(0.0), lambda s, x: s + x) / h
    return F.array(*[mean(h) for h in at])


def tiled(v: Column, n: int) -> Column:
    """v repeated to n values."""
    return F.slice(F.flatten(F.array_repeat(v, F.ceil(F.lit(n) / F.size(v)).cast("int"))), 1, n)


def pixels_to_unit(v: Column) -> Column:
    """0..255 to [-1, 1]."""
    return F.transform(v, lambda x: x / 127.5 - 1)


def _moved(pose: Column, delta: Column) -> Column:
    return bound(pose, lambda s: advanced(s["position"], s["rotation"], delta))


def forward_kinematics(joints: Column, chain: list[dict]) -> Column:
    """struct(position, rotation) of the last link of a serial chain.

    chain: {"kind": revolute | continuous | prismatic | fixed, "xyz", "rpy", "axis", "sign", "offset", "index"}; a link that
    moves takes the joint at its index, or the next one.
    """
    pose = (F.array(*[F.lit(0.0)] * 3), F.array(*[F.lit(float(x)) for x in (1, 0, 0, 0, 1, 0, 0, 0, 1)]))
    used, out = 0, F.struct(pose[0].alias("position"), pose[1].alias("rotation"))
    vec = lambda v: F.array(*[F.lit(float(x)) for x in v])
    for link in chain:
        fixed = F.struct(vec(link.get("xyz", (0, 0, 0))).alias("translation"), euler_to_matrix(vec(link.get("rpy", (0, 0, 0)))).alias("rotation"))
        out = _moved(out, fixed)
        if link["kind"] != "fixed":
            q = F.get(joints, F.lit(link.get("index", used))) * float(link.get("sign", 1)) + float(link.get("offset", 0))
            used += 1
            axis = link.get("axis", (0, 0, 1))
            n = math.sqrt(sum(a * a for a in axis))
            ax = [a / n for a in axis]
            if link["kind"] == "prismatic":
                move = F.struct(F.array(*[F.lit(a) * q for a in ax]).alias("translation"), vec((1, 0, 0, 0, 1, 0, 0, 0, 1)).alias("rotation"))
            else:
                turn = F.array(*[F.lit(a) * F.sin(q / 2) for a in ax], F.cos(q / 2))
                move = F.struct(vec((0, 0, 0)).alias("translation"), quaternion_to_matrix(turn).alias("rotation"))
            out = _moved(out, move)
    return out


def pose_parts(pose: Column) -> Column:
    """struct(position, rotation) of xyz and a quaternion."""
    return bound(pose, lambda p: F.struct(F.slice(p, 1, 3).alias("position"), quaternion_to_matrix(F.slice(p, 4, 4)).alias("rotation")))


def pose_to_euler(pose: Column) -> Column:
    """xyz and a quaternion as xyz and angles."""
    return bound(pose, lambda p: F.concat(F.slice(p, 1, 3), matrix_to_euler(quaternion_to_matrix(F.slice(p, 4, 4)))))


def difference_action(pose: Column, later: Column, gripper: Column, later_gripper: Column, t_scale: float, r_scale: float, g_scale: float) -> Column:
    """Seven channels of the step between two poses, the gripper as a difference: translation, angles and gripper over their
    scales, clipped to [-1, 1]."""
    def steps(p: Column) -> Column:
        delta = local_delta(p["a"]["position"], p["a"]["rotation"], p["b"]["position"], p["b"]["rotation"])
        return bound(delta, lambda d: clipped(F.concat(scaled(d["translation"], F.lit(1 / t_scale)), scaled(matrix_to_euler(d["rotation"]), F.lit(1 / r_scale)), F.array((later_gripper - gripper) / g_scale))))

    return bound(F.struct(pose_parts(pose).alias("a"), pose_parts(later).alias("b")), steps)


def audit_fields(pose: Column, target: Column, gripper: Column, target_gripper: Column, joints: Column, target_joints: Column) -> Column:
    """What an arm is at, is to be at, and the step between: rotations as six numbers, poses, grippers and joints, none normalised.

    Joints of different numbers fail.
    """
    same = F.when(F.size(joints) != F.size(target_joints), F.raise_error(F.lit("joints differ in number")).cast("array<double>")).otherwise(minus(target_joints, joints))

    def fields(p: Column) -> Column:
        delta = local_delta(p["a"]["position"], p["a"]["rotation"], p["b"]["position"], p["b"]["rotation"])
        return bound(delta, lambda d: F.struct(
            matrix_to_six(p["a"]["rotation"]).alias("rotation_6d"), pose.alias("ee_pose"), gripper.alias("gripper"), matrix_to_six(p["b"]["rotation"]).alias("target_rotation_6d"),
            matrix_to_six(d["rotation"]).alias("delta_rotation_6d"), target.alias("target_ee_pose"), F.concat(d["translation"], matrix_to_euler(d["rotation"])).alias("delta_xyz_euler"), target_gripper.alias("target_gripper"),
            joints.alias("joints"), target_joints.alias("target_joints"), same.alias("delta_joints"),
        ))

    return bound(F.struct(pose_parts(pose).alias("a"), pose_parts(target).alias("b")), fields)


def center(plane: Column, rows: int, columns: int, size: int) -> Column:
    """The size x size cells in the middle of a flat plane of rows x columns; a plane of another shape fails."""
    if not 0 < size <= min(rows, columns):
        raise ValueError(f"size must be in 1..{min(rows, columns)}")
    top, left = (rows - size) // 2, (columns - size) // 2
    whole = F.when(F.size(plane) == rows * columns, plane).otherwise(F.raise_error(F.lit("plane has another shape")).cast("array<double>"))
    return bound(whole, lambda p: F.flatten(F.array(*[F.slice(p, (top + r) * columns + left + 1, size) for r in range(size)])))


def named_ranges(clip: Column, bounds: dict[str, tuple[int, int]], frames: int) -> Column:
    """struct of the named ranges [start, stop) of a clip, an array of frames; a clip of another length fails."""
    kind = F.when(F.size(clip) == frames, clip).otherwise(F.raise_error(F.lit("clip has another length")))
    return bound(kind, lambda c: F.struct(*[F.slice(c, a + 1, b - a).alias(n) for n, (a, b) in bounds.items()]))


def as_scalar(v: Column) -> Column:
    """The element of an array of one; a longer array fails."""
    return F.when(F.size(v) > 1, F.raise_error(F.lit("more than one element")).cast("double")).otherwise(F.get(v, F.lit(0)))


def as_array(v: Column) -> Column:
    return F.when(v.isNotNull(), F.array(v))


def strided(plane: Column, rows: int, columns: int, most: int) -> Column:
    """Every k-th row and column of a flat plane, with the smallest k that leaves at most `most` of the longer side."""
    k = max(1, -(-max(rows, columns) // most))
    return F.flatten(F.array(*[F.array(*[F.get(plane, F.lit(r * columns + c)) for c in range(0, columns, k)]) for r in range(0, rows, k)]))
