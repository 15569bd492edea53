"""SQL of filters whose formulas take several steps: hue, geometry, warping, deinterlacing, resampling, control.

Each is written from the formula, on lists of a frame's values and joins, and
shares no code with the kernels.
"""

from __future__ import annotations

from framelake.sources.tables import SQL_PACKETS, SQL_PIXELS, SQL_SAMPLES


def hsv(hue: int, saturation: int, value: int) -> str:
    """The hexagon model: centre and range of the channels, the place on the hexagon's edges, and back."""
    if value > 0:
        centre = f"xor((xor(hi + lo, 511) * {256 - value} + 128) >> 8, 511)"
    else:
        centre = f"((hi + lo) * {256 + value} + 128) >> 8"
    rise = lambda o: f"greatest(0, least(n, abs((spot + {o} * n) % greatest(6 * n, 1) - 3 * n) - n))"
    scaled = ", ".join(f"least(n, (({c} - lo) * n * scale + 32768) >> 16) AS {c}1" for c in "rgb")
    channels = ", ".join(f"CAST(CASE WHEN span = 0 OR n <= 0 THEN base ELSE {rise(o)} + base END AS INT) AS {c}" for c, o in zip("rgb", (0, 4, 2), strict=True))
    return f"""WITH {SQL_PIXELS}, a AS (SELECT frame, x, y, r::BIGINT AS r, g::BIGINT AS g, b::BIGINT AS b, greatest(r, g, b)::BIGINT AS hi, least(r, g, b)::BIGINT AS lo FROM px),
c AS (SELECT *, hi - lo AS span, {centre} AS mid FROM a),
d AS (SELECT *, least((span * {saturation} + 128) >> 8, least(mid, 511 - mid)) AS fresh FROM c),
e AS (SELECT *, (mid - fresh) >> 1 AS base, ((mid + fresh) >> 1) - ((mid - fresh) >> 1) AS n,
  CASE WHEN span > 0 THEN 65536 // span + CASE WHEN 65536 % span * 2 >= span THEN 1 ELSE 0 END ELSE 0 END AS scale FROM d),
f AS (SELECT *, {scaled} FROM e),
h AS (SELECT *, (CASE WHEN r1 = n AND b1 = 0 THEN g1 WHEN g1 = n AND b1 = 0 THEN 2 * n - r1 WHEN g1 = n AND r1 = 0 THEN 2 * n + b1
  WHEN b1 = n AND r1 = 0 THEN 4 * n - g1 WHEN b1 = n AND g1 = 0 THEN 4 * n + r1 ELSE 6 * n - b1 END + ((n * {hue} + 128) >> 8)) % greatest(6 * n, 1) AS spot FROM f)
SELECT frame, x, y, {channels} FROM h"""


_CUBIC = "CASE WHEN t < 1 THEN 1 + t * t * (-2.25::DOUBLE + 1.25::DOUBLE * t) WHEN t < 2 THEN 3.0::DOUBLE + t * (-6.0::DOUBLE + t * (3.75::DOUBLE - 0.75::DOUBLE * t)) ELSE 0.0::DOUBLE END"
_LINEAR = "greatest(0.0::DOUBLE, 1 - t)"


def sampled(sx: str, sy: str, cubic: bool, fill: tuple[int, int, int] | None) -> str:
    """8 x 8 pixels at real places sx, sy (of x, y) by separable kernels; a colour beyond the edges, or the edge's pixel."""
    lo, hi = (-1, 3) if cubic else (0, 2)
    weight = lambda d: f"(SELECT {_CUBIC if cubic else _LINEAR} FROM (SELECT abs({d}) AS t))"
    value = lambda c: f"greatest(0, least(255, floor(round(sum(t.w * p.{c}), 9) + 0.5)))"
    channels = ", ".join(f"CAST({value(c) if fill is None else f'CASE WHEN any_value(t.beyond) THEN {fill[i]} ELSE {value(c)} END'} AS INT) AS {c}" for i, c in enumerate("rgb"))
    return f"""WITH {SQL_PIXELS}, g AS (SELECT x, y, {sx} AS sx, {sy} AS sy FROM range(0, 8) a(x), range(0, 8) b(y)),
taps AS (SELECT x, y, sx < -0.5 OR sx > 7.5 OR sy < -0.5 OR sy > 7.5 AS beyond, greatest(0, least(7, CAST(floor(sx) AS INT) + dx)) AS qx, greatest(0, least(7, CAST(floor(sy) AS INT) + dy)) AS qy,
  {weight('sx - floor(sx) - dx')} * {weight('sy - floor(sy) - dy')} AS w FROM g, range({lo}, {hi}) c(dx), range({lo}, {hi}) d(dy))
SELECT p.frame, CAST(t.x AS INT) AS x, CAST(t.y AS INT) AS y, {channels} FROM taps t JOIN px p ON p.x = t.qx AND p.y = t.qy GROUP BY p.frame, t.x, t.y"""


def rotated(degrees: float, fill: tuple[int, int, int]) -> str:
    c, s = f"cos(radians({degrees}::DOUBLE))", f"sin(radians({degrees}::DOUBLE))"
    return sampled(f"{c} * (x - 3.5::DOUBLE) - {s} * (y - 3.5::DOUBLE) + 3.5::DOUBLE", f"{s} * (x - 3.5::DOUBLE) + {c} * (y - 3.5::DOUBLE) + 3.5::DOUBLE", True, fill)


def in_perspective(corners: list[tuple[float, float]]) -> str:
    """The square's map to a quadrangle in closed form: corners are top left, top right, bottom left, bottom right."""
    (x0, y0), (x1, y1), (x3, y3), (x2, y2) = corners  # around the square
    sx, sy = x0 - x1 + x2 - x3, y0 - y1 + y2 - y3
    dx1, dx2, dy1, dy2 = x1 - x2, x3 - x2, y1 - y2, y3 - y2
    det = dx1 * dy2 - dx2 * dy1
    g, h = (sx * dy2 - dx2 * sy) / det, (dx1 * sy - sx * dy1) / det
    u, v = "((x + 0.5::DOUBLE) / 8)", "((y + 0.5::DOUBLE) / 8)"
    line = lambda a, b, c: f"(({a!r})::DOUBLE * {u} + ({b!r})::DOUBLE * {v} + ({c!r})::DOUBLE)"
    below = line(g, h, 1)
    return sampled(f"{line(x1 - x0 + g * x1, x3 - x0 + h * x3, x0)} / {below}", f"{line(y1 - y0 + g * y1, y3 - y0 + h * y3, y0)} / {below}", False, None)


def _at(values: str, x: str, y: str, w: int, h: int) -> str:
    """A value of a frame's list in row order; edges replicate."""
    return f"{values}[greatest(0, least({h - 1}, {y})) * {w} + greatest(0, least({w - 1}, {x})) + 1]"


def warped(depth: int, source: str, w: int = 8, h: int = 8) -> str:
    """source: CTEs that end in pic (frame, x, y, r, g, b). Moves pixels along the slope of a blurred edge map."""
    cells = f"range(0, {w}) a(x), range(0, {h}) b(y)"
    near = lambda l, dx, dy: _at(l, f"x + ({dx})", f"y + ({dy})", w, h)
    relist = lambda name, table: f"{name} AS (SELECT frame, list(v ORDER BY y, x) AS l FROM {table} GROUP BY frame)"
    blur = lambda dx, dy: f"({near('l', -dx, -dy)} + 2 * {near('l', 0, 0)} + {near('l', dx, dy)} + 2) >> 2"
    corner = lambda c, ox, oy: _at(f"p.{c}", f"least(sx // 256 + {ox}, {w - 1})", f"least(sy // 256 + {oy}, {h - 1})", w, h)
    mixed = lambda c: (
        f"CAST(((({corner(c, 0, 0)} * (256 - (sx & 255)) + {corner(c, 1, 0)} * (sx & 255)) * (256 - (sy & 255)) "
        f"+ ({corner(c, 0, 1)} * (256 - (sx & 255)) + {corner(c, 1, 1)} * (sx & 255)) * (sy & 255) + 32768) >> 16) AS INT) AS {c}"
    )
    return f"""WITH {source}, gray AS (SELECT frame, x, y, ((54 * r + 183 * g + 19 * b) >> 8)::BIGINT AS v FROM pic), {relist('gl', 'gray')},
bump AS (SELECT frame, x, y, least(255, abs({near('l', 1, 0)} - {near('l', -1, 0)}) + abs({near('l', 0, 1)} - {near('l', 0, -1)})) AS v FROM gl, {cells}), {relist('bl', 'bump')},
rows_ AS (SELECT frame, x, y, {blur(1, 0)} AS v FROM bl, {cells}), {relist('rl', 'rows_')},
soft AS (SELECT frame, x, y, {blur(0, 1)} AS v FROM rl, {cells}), {relist('sl', 'soft')},
place AS (SELECT frame, x, y, greatest(0, least({(w - 1) * 256}, x * 256 - ({near('l', 1, 0)} - {near('l', -1, 0)}) * {depth})) AS sx, greatest(0, least({(h - 1) * 256}, y * 256 - ({near('l', 0, 1)} - {near('l', 0, -1)}) * {depth})) AS sy FROM sl, {cells}),
pl AS (SELECT frame, {', '.join(f'list({c}::BIGINT ORDER BY y, x) AS {c}' for c in 'rgb')} FROM pic GROUP BY frame)
SELECT q.frame, CAST(q.x AS INT) AS x, CAST(q.y AS INT) AS y, {', '.join(mixed(c) for c in 'rgb')} FROM place q JOIN pl p USING (frame)"""


#: Edge-directed rows for the missing (odd) rows of 8 x 8 frames, as CTEs that end in ela (frame, x, y, r, g, b).
def _ela() -> str:
    cl = lambda e: f"greatest(0, least(7, {e})) + 1"
    one = lambda d: " + ".join(f"abs(u_{c}[{cl(f'x + ({d})')}] - d_{c}[{cl(f'x - ({d})')}])" for c in "rgb")
    ones = ", ".join(f"{one(d)} AS o{d + 2}" for d in range(-2, 3))
    lists = ", ".join(f"list(o{k} ORDER BY x) AS l{k}" for k in range(5))
    score = lambda k: f"l{k}[{cl('x - 1')}] + 2 * l{k}[x + 1] + l{k}[{cl('x + 1')}]"
    new = lambda c: f"(u_{c}[{cl('x + way')}] + d_{c}[{cl('x - way')}] + 1) >> 1"
    return f"""lines AS (SELECT frame, y, {', '.join(f'list({c} ORDER BY x) AS {c}' for c in 'rgb')} FROM px GROUP BY frame, y),
around AS (SELECT m.frame, m.y, {', '.join(f'u.{c} AS u_{c}, d.{c} AS d_{c}' for c in 'rgb')} FROM lines m JOIN lines u ON u.frame = m.frame AND u.y = m.y - 1 JOIN lines d ON d.frame = m.frame AND d.y = CASE WHEN m.y = 7 THEN 6 ELSE m.y + 1 END WHERE m.y % 2 = 1),
ones AS (SELECT *, CAST(xx AS INT) AS x, {ones.replace('x +', 'xx +').replace('x -', 'xx -')} FROM around, range(0, 8) t(xx)),
sums AS (SELECT frame, y, {lists} FROM ones GROUP BY frame, y),
scores AS (SELECT frame, y, CAST(x AS INT) AS x, {', '.join(f'{score(k)} AS s{k}' for k in range(5))} FROM sums, range(0, 8) t(x)),
w1 AS (SELECT *, CASE WHEN s1 < s2 THEN CASE WHEN s0 < s1 THEN -2 ELSE -1 END ELSE 0 END AS left_, CASE WHEN s1 < s2 THEN least(s0, s1) ELSE s2 END AS best FROM scores),
way AS (SELECT frame, y, x, CASE WHEN s3 < best THEN CASE WHEN s4 < s3 THEN 2 ELSE 1 END ELSE left_ END AS way FROM w1),
ela AS (SELECT frame, x, y, {', '.join(f'{new(c)} AS {c}' for c in 'rgb')} FROM way JOIN around USING (frame, y))"""


def edge_lines() -> str:
    return f"WITH {SQL_PIXELS}, {_ela()} SELECT frame, x, y, CAST(r AS INT) AS r, CAST(g AS INT) AS g, CAST(b AS INT) AS b FROM ela UNION ALL SELECT frame, x, y, r, g, b FROM px WHERE y % 2 = 0"


def yadif() -> str:
    """The edge-directed row, held within what the frames before and after allow."""
    at = lambda l, e: f"{l}[greatest(0, least(7, {e})) + 1]"

    def channel(c: str) -> str:
        p, q, n = f"p.{c}", f"k.{c}", f"n.{c}"  # previous, this and next column
        up, down = at(q, "e.y - 1"), at(q, "e.y + 1")
        middle = f"(({at(p, 'e.y')} + {at(q, 'e.y')} + 1) >> 1)"
        changes = [f"abs({at(p, 'e.y')} - {at(q, 'e.y')}) >> 1"] + [f"(abs({at(o, 'e.y - 1')} - {up}) + abs({at(o, 'e.y + 1')} - {down})) >> 1" for o in (p, n)]
        far = lambda d: f"(({at(p, f'e.y + ({d})')} + {at(q, f'e.y + ({d})')} + 1) >> 1)"
        least = f"least({middle} - {down}, {middle} - {up})"
        most = f"greatest({middle} - {down}, {middle} - {up})"
        upper = f"least({least}, greatest({far(-2)} - {up}, {far(2)} - {down}))"
        lower = f"greatest({most}, least({far(-2)} - {up}, {far(2)} - {down}))"
        span = f"greatest({', '.join(changes)}, {upper}, -({lower}), 0)"
        return f"CAST(greatest({middle} - {span}, least({middle} + {span}, e.{c})) AS INT) AS {c}"

    columns = f"cols AS (SELECT frame, x, {', '.join(f'list({c} ORDER BY y) AS {c}' for c in 'rgb')} FROM px GROUP BY frame, x), ends AS (SELECT min(frame) AS a, max(frame) AS z FROM px)"
    return f"""WITH {SQL_PIXELS}, {_ela()}, {columns} SELECT e.frame, e.x, e.y, {', '.join(channel(c) for c in 'rgb')} FROM ela e, ends JOIN cols k ON true JOIN cols p ON true JOIN cols n ON true
WHERE k.frame = e.frame AND k.x = e.x AND p.frame = greatest(ends.a, e.frame - 1) AND p.x = e.x AND n.frame = least(ends.z, e.frame + 1) AND n.x = e.x
UNION ALL SELECT frame, x, y, r, g, b FROM px WHERE y % 2 = 0"""


def resampled(ratio: str, half: int = 16) -> str:
    """A windowed sinc at 256 phases, each phase's taps summing to one; silence beyond the ends."""
    cutoff = f"least(1.0::DOUBLE, {ratio}::DOUBLE)"
    sinc = f"CASE WHEN k * {cutoff} = 0 THEN 1.0::DOUBLE ELSE sin(pi() * k * {cutoff}) / (pi() * k * {cutoff}) END"
    return f"""WITH {SQL_SAMPLES}, raw AS (SELECT phase, tap, CASE WHEN abs(k) <= {half} THEN {sinc} * (0.42::DOUBLE + 0.5::DOUBLE * cos(pi() * k / {half}) + 0.08::DOUBLE * cos(2 * pi() * k / {half})) ELSE 0 END AS v
  FROM (SELECT phase, tap, tap - phase / 256::DOUBLE AS k FROM range(0, 256) a(phase), range({1 - half}, {half + 1}) b(tap))),
bank AS (SELECT phase, tap, v / sum(v) OVER (PARTITION BY phase) AS w FROM raw),
places AS (SELECT i AS pos, CAST(floor(i / {ratio}::DOUBLE * 256 + 0.5) AS BIGINT) AS s FROM range(0, (SELECT CAST(floor(count(*) * {ratio}::DOUBLE + 0.5) AS BIGINT) FROM smp)) t(i))
SELECT p.pos, {', '.join(f'CAST(greatest(-32768, least(32767, floor(coalesce(sum(b.w * m.{c}), 0) + 0.5))) AS INT) AS {c}' for c in 'lr')}
FROM places p JOIN bank b ON b.phase = p.s & 255 LEFT JOIN smp m ON m.pos = (p.s >> 8) + b.tap GROUP BY p.pos"""


def controlled() -> str:
    """A smoothed input, proportional and integral parts, and no winding up at the limit, step by step."""
    return f"""WITH RECURSIVE {SQL_PACKETS}, e AS (SELECT user_id AS stream, seq, (bytes % 200 - 100) / 10.0::DOUBLE AS error, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS k FROM pkt),
walk(stream, k, seq, level, total, correction) AS (
  SELECT stream, CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM e WHERE k = 1
  UNION ALL SELECT stream, k, seq, level, CASE WHEN abs(raw) < 0.1::DOUBLE THEN total + level ELSE total END, greatest(-0.1::DOUBLE, least(0.1::DOUBLE, raw))
  FROM (SELECT *, -0.05::DOUBLE * level + -0.005::DOUBLE * (total + level) AS raw FROM
    (SELECT e.stream, e.k, e.seq, walk.total, walk.level + (e.error - walk.level) / 32.0::DOUBLE AS level FROM walk JOIN e ON e.stream = walk.stream AND e.k = walk.k + 1)))
SELECT stream, seq, round(correction, 9) AS correction FROM walk WHERE k > 0"""
