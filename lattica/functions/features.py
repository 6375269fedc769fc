"""Point and segment features: colours, local geometry, ground, positions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import eigen

XYZ = ("x", "y", "z")


def rgb2hsv(r: Column, g: Column, b: Column, eps: float = 1e-10) -> list[Column]:
    """Hue in degrees, saturation and value of colours in 0..1."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low + eps
    hue = F.when(b == low, 60 * (g - r) / span + 60).when(r == low, 60 * (b - g) / span + 180).otherwise(60 * (r - b) / span + 300)
    return [hue.alias("h"), ((top - low) / (top + eps)).alias("s"), top.alias("v")]


def rgb2lab(r: Column, g: Column, b: Column) -> list[Column]:
    """CIE Lab (D65) of sRGB colours in 0..1; XYZ and Lab are rounded to four places, halves to even."""
    lin = [F.when(c > 0.04045, F.pow((c + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 12.92) * 100 for c in (r, g, b)]
    # fixed values: sRGB to XYZ, and the white point
    rows = ((0.4124, 0.3576, 0.1805), (0.2126, 0.7152, 0.0722), (0.0193, 0.1192, 0.9505))
    white = (95.047, 100.0, 108.883)
    xyz = [F.bround(sum((m * c for m, c in zip(row[1:], lin[1:])), row[0] * lin[0]), 4) / w for row, w in zip(rows, white)]
    f = [F.when(v > 0.008856, F.pow(v, F.lit(1 / 3))).otherwise(7.787 * v + 16 / 116) for v in xyz]
    lab = (116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2]))
    return [F.bround(c, 4).alias(n) for c, n in zip(lab, ("l", "a", "b"))]


def scaled_rgb(df: DataFrame, cols=("r", "g", "b")) -> DataFrame:
    """Colours in 0..1: divided by 255 if any is above 1, then clamped."""
    top = F.broadcast(df.agg(F.max(F.array_max(F.array(*cols))).alias("_top")))
    out = df.crossJoin(top)
    for c in cols:
        v = F.when(F.col("_top") > 1, F.col(c) / 255.0).otherwise(F.col(c).cast("double"))
        out = out.withColumn(c, F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))
    return out.drop("_top")


def byte_rgb(df: DataFrame, cols=("r", "g", "b")) -> DataFrame:
    """Colours as whole numbers of 0..255: times 255 if none is above 1, then clamped and cut."""
    top = F.broadcast(df.agg(F.max(F.array_max(F.array(*cols))).alias("_top")))
    out = df.crossJoin(top)
    for c in cols:
        v = F.when(F.col("_top") <= 1, F.col(c) * 255.0).otherwise(F.col(c).cast("double"))
        out = out.withColumn(c, F.greatest(F.lit(0.0), F.least(F.lit(255.0), v)).cast("int"))
    return out.drop("_top")


def plot_colour(r: Column, g: Column, b: Column, alpha: Column | None = None) -> Column:
    """`rgb(...)` or `rgba(...)` for plots, of colours in 0..1; each is cut to a whole number of 0..255."""
    whole = [(c * 255).cast("int") for c in (r, g, b)]
    return F.format_string("rgb(%d,%d,%d)", *whole) if alpha is None else F.format_string("rgba(%d,%d,%d,%.2f)", *whole, alpha)


def float_pair(c: Column) -> tuple[Column, Column]:
    """A double as two floats: the nearest one, and what is left."""
    high = c.cast("float")
    return high, (c - high.cast("double")).cast("float")


def from_float_pair(high: Column, low: Column) -> Column:
    return high.cast("double") + low.cast("double")


def simplex_projection(x: Column, width: int, dim: int = 3) -> Column:
    """The first `dim` coordinates of a feature array in an orthonormal base of the plane in which all features count alike.

    Axis i weighs features 0..i-1 against feature i, so the base doesn't depend on the data; the simplex's centre drops out.
    """
    from .expr import dot

    axes = [[1 / math.sqrt(i * (i + 1))] * i + [-i / math.sqrt(i * (i + 1))] + [0.0] * (width - i - 1) for i in range(1, dim + 1)]
    return F.array(*[dot(x, F.array(*[F.lit(v) for v in axis])) for axis in axes])


def min_max_normalized(df: DataFrame, cols: list[str], keys: list[str] = ()) -> DataFrame:
    """Each column stretched to 0..1; what can't be is 0."""
    box = df.groupBy(*keys).agg(*[f(c).alias(f"_{n}{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])
    out = df.join(box, list(keys)) if keys else df.crossJoin(F.broadcast(box))
    for c in cols:
        span = F.col(f"_hi{c}") - F.col(f"_lo{c}")
        out = out.withColumn(c, F.when(span > 0, (F.col(c) - F.col(f"_lo{c}")) / span).otherwise(F.lit(0.0)))
    return out.drop(*[f"_{n}{c}" for c in cols for n in ("lo", "hi")])


def auto_contrast(df: DataFrame, cols=("r", "g", "b"), blend: float = 0.5) -> DataFrame:
    """Colours blended with their min-max stretch."""
    wide = min_max_normalized(df.select("*", *[F.col(c).alias(f"_n{c}") for c in cols]), [f"_n{c}" for c in cols])
    for c in cols:
        wide = wide.withColumn(c, (1 - blend) * F.col(c) + blend * F.col(f"_n{c}"))
    return wide.drop(*[f"_n{c}" for c in cols])


#: Mean and deviation that colours are normalized by.
COLOR_MEAN, COLOR_STD = (0.5136457, 0.49523646, 0.44921124), (0.18308958, 0.18415008, 0.19252081)


def color_normalized(df: DataFrame, cols=("r", "g", "b"), mean=COLOR_MEAN, std=COLOR_STD) -> DataFrame:
    return df.withColumns({c: (F.col(c) - m) / s for c, m, s in zip(cols, mean, std)})


def color_dropped(df: DataFrame, cols=("r", "g", "b"), p: float = 0.2, seed: int = 0) -> DataFrame:
    """All colours zero, or none, by one coin with chance p."""
    gone = bool(np.random.default_rng(seed).random() < p)
    return df.withColumns({c: F.lit(0.0) for c in cols}) if gone else df


def hex_to_rgb(h: Column) -> list[Column]:
    """r, g, b of `#rrggbb`."""
    return [F.conv(F.substring(h, i, 2), 16, 10).cast("int").alias(c) for c, i in zip("rgb", (2, 4, 6))]


def density(neighbors: DataFrame) -> DataFrame:
    """(i, density): neighbours per square of the distance to the farthest; null where that is 0."""
    return neighbors.groupBy("i").agg(F.try_divide(F.count(F.lit(1)), F.pow(F.max("d"), F.lit(2))).alias("density"))


def covariances(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, cxx, cxy, cxz, cyy, cyz, czz): population covariances, partial before the shuffle."""
    pairs = [(a, b) for i, a in enumerate(XYZ) for b in XYZ[i:]]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in pairs])


def eigen_features(cov: DataFrame, k_min: int = 5) -> DataFrame:
    """`cov` with linearity, planarity, scattering, length, surface, volume, curvature, verticality and normal nx, ny, nz.

    From the roots of the eigenvalues, largest first. Groups of fewer than k_min get zeros. The normal points to z+. All is
    column expressions (`eigen`).
    """
    names, out = list(cov.columns), cov
    for level in eigen.levels(eigen.steps() + eigen.feature_steps(k_min)):
        out = out.withColumns({name: F.expr(e) for name, e in level.items()})
    return out.select(*[F.col(f"`{c}`") for c in names], *[n for n, _ in eigen.feature_steps(k_min) if not n.startswith("_")])


def point_geometry(points: DataFrame, neighbors: DataFrame, k_min: int = 5) -> DataFrame:
    """Eigen features of each point's neighbourhood, itself included."""
    pairs = neighbors.select("i", F.col("j").alias("pid")).union(points.select(F.col("pid").alias("i"), "pid"))
    return eigen_features(covariances(pairs.join(points.select("pid", *XYZ), "pid"), ["i"]), k_min)


def segment_features(points: DataFrame, group: str, keys: list[str] = (), k_min: int = 5) -> DataFrame:
    """Per segment: eigen features, log_size, and mean and deviation of `keys` (0 where there is one point)."""
    aggs = [F.avg(k).alias(f"mean_{k}") for k in keys] + [F.coalesce(F.stddev_samp(k), F.lit(0.0)).alias(f"std_{k}") for k in keys]
    logs = ((F.log(F.count(F.lit(1)) + 1) - math.log(2)) / 10).alias("log_size")
    own = points.groupBy(group).agg(logs, *aggs)
    return eigen_features(covariances(points, [group]), k_min).join(own, group)


def mean_orientation(df: DataFrame, group: str, cols=("nx", "ny", "nz")) -> DataFrame:
    """(group, nx, ny, nz): the mean direction of unit normals regardless of their sign, pointing to z+.

    Groups whose mean elevation is under 45 degrees turn the normals that oppose their flattest one.
    """
    n = [F.col(c) for c in cols]
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    unit = df.select(group, *[(c / F.when(size > 0, size).otherwise(F.lit(1.0))).alias(f"u{i}") for i, c in enumerate(n)])
    unit = unit.withColumn("phi", F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("u2")))))
    key = F.struct("phi", "u0", "u1", "u2")
    lead = unit.groupBy(group).agg(F.avg("phi").alias("mean_phi"), F.min(key).alias("m"))
    rows = unit.join(lead, group)
    side = F.col("u0") * F.col("m.u0") + F.col("u1") * F.col("m.u1") + F.col("u2") * F.col("m.u2")
    sign = F.when((F.col("mean_phi") < math.pi / 4) & (side < 0), -1.0).otherwise(1.0)
    mean = rows.groupBy(group).agg(*[F.avg(sign * F.col(f"u{i}")).alias(f"v{i}") for i in range(3)])
    v = [F.col(f"v{i}") for i in range(3)]
    length = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    up = F.when(v[2] < 0, -1.0).otherwise(1.0) / F.when(length > 0, length).otherwise(F.lit(1.0))
    return mean.select(group, *[(c * up).alias(name) for c, name in zip(v, cols)])


def weighted_mean(df: DataFrame, group: str, value: str, weight: str) -> DataFrame:
    """(group, mean); a group whose weights sum to 0 is divided by 1."""
    total = F.sum(weight)
    return df.groupBy(group).agg((F.sum(F.col(value) * F.col(weight)) / F.when(total == 0, F.lit(1.0)).otherwise(total)).alias("mean"))


def unit_sphere(df: DataFrame, group: str) -> DataFrame:
    """Positions relative to their group's mean, by its largest extent (plus 0.01), with log_diameter."""
    extent = F.greatest(*[F.max(d) - F.min(d) for d in XYZ])
    box = df.groupBy(group).agg(*[F.avg(d).alias(f"_m{d}") for d in XYZ], extent.alias("diameter"))
    return df.join(box, group).withColumns({d: (F.col(d) - F.col(f"_m{d}")) / (F.col("diameter") + 1e-2) for d in XYZ}).drop(*[f"_m{d}" for d in XYZ])


def fourier_encoded(pos: list[Column], dim: int, f_min: float = 0.1, f_max: float = 10.0) -> Column:
    """`dim` numbers: cosines and sines of pos * pi / 2 at frequencies that grow geometrically, padded with zeros.

    The exponents run from ln f_min to ln f_max on a base of 10.
    """
    per = dim // len(pos)
    half = (per + 1) // 2
    steps = [10 ** (math.log(f_min) + (math.log(f_max) - math.log(f_min)) * i / max(1, half - 1)) for i in range(half)]
    out = [f(p * (math.pi / 2) * steps[i // 2]) for p in pos for i in range(per) for f in ((F.cos, F.sin)[i % 2],)]
    return F.array(*out, *[F.lit(0.0)] * (dim - len(out)))


def rodrigues(axis: tuple[float, float, float], degrees: float) -> list[list[float]]:
    """The matrix of a rotation about an axis."""
    n = math.sqrt(sum(a * a for a in axis))
    x, y, z = (a / n for a in axis)
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    k = ((0, -z, y), (z, 0, -x), (-y, x, 0))
    kk = [[sum(k[i][m] * k[m][j] for m in range(3)) for j in range(3)] for i in range(3)]
    return [[(i == j) + s * k[i][j] + (1 - c) * kk[i][j] for j in range(3)] for i in range(3)]


def rotated(df: DataFrame, matrix: list[list[float]], cols=XYZ) -> DataFrame:
    return df.withColumns({c: sum((row[i] * F.col(cols[i]) for i in (1, 2)), row[0] * F.col(cols[0])) for c, row in zip(cols, matrix)})


def scaled(df: DataFrame, factors: tuple[float, float, float], cols=XYZ) -> DataFrame:
    return df.withColumns({c: F.col(c) * f for c, f in zip(cols, factors)})


def flipped(df: DataFrame, axis: str) -> DataFrame:
    return df.withColumn(axis, -F.col(axis))


def centered(df: DataFrame, reference: DataFrame) -> DataFrame:
    """Positions less the mean position of `reference`."""
    mean = F.broadcast(reference.agg(*[F.avg(d).alias(f"_m{d}") for d in XYZ]))
    return df.crossJoin(mean).withColumns({d: F.col(d) - F.col(f"_m{d}") for d in XYZ}).drop(*[f"_m{d}" for d in XYZ])


def room_position(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """`df` with room_x, room_y: the position in the bounding box, from 0 to 1."""
    out = min_max_normalized(df.select("*", F.col("x").alias("room_x"), F.col("y").alias("room_y")), ["room_x", "room_y"], keys)
    return out


def base_vectors(x: Column, y: Column, z: Column) -> list[Column]:
    """An orthonormal base b0, b1, b2 (nine columns) whose first vector is along (x, y, z); (0, 0, 1) stands for zero."""
    size = F.sqrt(x * x + y * y + z * z)
    u = [F.when(size > 0, c / size).otherwise(F.lit(d)) for c, d in zip((x, y, z), (0.0, 0.0, 1.0))]
    flat = F.abs(u[2]) < 0.999999
    across = F.sqrt(u[0] * u[0] + u[1] * u[1])
    v = [F.when(flat, -u[1] / across).otherwise(F.lit(1.0)), F.when(flat, u[0] / across).otherwise(F.lit(0.0)), F.lit(0.0)]
    w = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    return [c.alias(f"b{i}{d}") for i, vec in enumerate((u, v, w)) for c, d in zip(vec, XYZ)]


def near_global_min(df: DataFrame, threshold: float) -> DataFrame:
    low = F.broadcast(df.agg(F.min("z").alias("_low")))
    return df.crossJoin(low).where(F.col("z") - F.col("_low") < threshold).drop("_low")


def low_verticality(df: DataFrame, threshold: float, verticality: str = "verticality") -> DataFrame:
    """The points on surfaces that are flat enough to be ground; a null verticality isn't."""
    return df.where(F.col(verticality) < threshold)


def local_z_min(df: DataFrame, grid: float) -> DataFrame:
    """The lowest point of each XY cell (ties: smallest pid)."""
    cells = [(F.col(d) / grid).cast("long").alias(f"c{d}") for d in "xy"]
    low = df.select("*", *cells).groupBy("cx", "cy").agg(F.min(F.struct("z", "pid")).alias("m")).select(F.col("m.pid").alias("pid"))
    return df.join(low, "pid", "left_semi")


def ground_elevation(df: DataFrame, ground: DataFrame, k: int = 3, r: float = 10.0, scale: float = 3.0) -> DataFrame:
    """`df` with elevation: height over the ground points' inverse-distance mean at this XY, by `scale`; null without any within r."""
    from ..operators.neighbors import knn_between

    near = knn_between(df, ground, k, r, ("x", "y"))
    z = near.join(ground.select(F.col("pid").alias("j"), F.col("z").alias("gz")), "j")
    w = 1 / (F.col("d") + 1e-3)
    level = z.groupBy(F.col("i").alias("pid")).agg((F.sum(w * F.col("gz")) / F.sum(w)).alias("_level"))
    return df.join(level, "pid", "left").withColumn("elevation", (F.col("z") - F.col("_level")) / scale).drop("_level")


def ground_plane(df: DataFrame) -> DataFrame:
    """One row a, b, c of the least squares plane z = a x + b y + c, from sums made before the shuffle."""
    s = df.agg(*[F.avg(d).alias(f"m{d}") for d in XYZ], *[F.covar_pop(p, q).alias(f"c{p}{q}") for p, q in (("x", "x"), ("x", "y"), ("y", "y"), ("x", "z"), ("y", "z"))])
    det = F.col("cxx") * F.col("cyy") - F.col("cxy") * F.col("cxy")
    a = (F.col("cxz") * F.col("cyy") - F.col("cyz") * F.col("cxy")) / det
    b = (F.col("cyz") * F.col("cxx") - F.col("cxz") * F.col("cxy")) / det
    return s.select(a.alias("a"), b.alias("b"), (F.col("mz") - a * F.col("mx") - b * F.col("my")).alias("c"))


def robust_ground_plane(df: DataFrame, residual: float, trials: int = 32, seed: int = 0) -> DataFrame:
    """RANSAC: planes through triples of points drawn by hash; the one with the most points within `residual`.

    The trial table has `trials` rows and is broadcast; the points are read once and counted per trial.
    """
    df = df.select("pid", *XYZ)
    pick = df.withColumn("_h", F.xxhash64(F.lit(seed), "pid")).orderBy("_h", "pid").limit(3 * trials)
    place = F.row_number().over(Window.orderBy("_h", "pid")) - 1
    t = pick.withColumn("k", place).groupBy((F.col("k") / 3).cast("int").alias("trial")).agg(F.sort_array(F.collect_list(F.struct("k", *XYZ))).alias("p")).where(F.size("p") == 3)
    p = [[F.col("p")[i][d] for d in XYZ] for i in range(3)]
    u, v = [p[1][i] - p[0][i] for i in range(3)], [p[2][i] - p[0][i] for i in range(3)]
    n = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    planes = t.select("trial", (-n[0] / n[2]).alias("a"), (-n[1] / n[2]).alias("b"), *[c.alias(f"_p{d}") for c, d in zip(p[0], XYZ)], n[2].alias("_n")).where(F.abs("_n") > 1e-9)
    planes = planes.select("trial", "a", "b", (F.col("_pz") - F.col("a") * F.col("_px") - F.col("b") * F.col("_py")).alias("c"))
    off = F.abs(F.col("z") - F.col("a") * F.col("x") - F.col("b") * F.col("y") - F.col("c"))
    votes = df.crossJoin(F.broadcast(planes)).where(off <= residual).groupBy("trial", "a", "b", "c").agg(F.count(F.lit(1)).alias("inliers"))
    return votes.orderBy(F.desc("inliers"), "trial").limit(1).select("a", "b", "c", "inliers")
