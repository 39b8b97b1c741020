"""SQL twins of the pixel jobs: the same formulas over long rows of (path, pos, r, g, b).

A step is a select list over the rows of the step before.  Names that a step defines for its own use
start with an underscore; columns of the step before go first where names clash.
"""

from __future__ import annotations

from .fixtures import RGB_SQL

KEYS = "path, pos"


def f32(x: str) -> str:
    """Pixels are 32-bit on the way in and out."""
    return f"cast(cast({x} as float) as double)"


def chain(*steps: str, ctes: str = "") -> str:
    """The common tables s0 (pixels as they come), s1, s2 ...: one a step."""
    base = ", ".join(f"{f32(f'{c} / 255.0::double')} as {c}" for c in "rgb")
    out = f"with {RGB_SQL}, {ctes}s0 as (select path, pos, {base} from rgb)"
    for k, step in enumerate(steps, 1):
        out += f", s{k} as (select {step if step.startswith('path') else KEYS + ', ' + step} from s{k - 1})"
    return out


def rounded(*steps: str, ctes: str = "") -> str:
    ends = ", ".join(f"round({f32(c)}, 4) as {c}" for c in "rgb")
    return f"{chain(*steps, ctes=ctes)} select path, cast(pos as int) as pos, {ends} from s{len(steps)}"


def each(form: str, **more: str) -> str:
    """A formula of {c} for each channel; ``more`` gives values by channel, as in k='1 2 3'."""
    return ", ".join(f"{form.format(c=c, **{n: v.split()[k] for n, v in more.items()})} as {c}" for k, c in enumerate("rgb"))


def luma(r: str = "r", g: str = "g", b: str = "b") -> str:
    return f"(0.2126::double * {r} + 0.7152::double * {g} + 0.0722::double * {b})"


def clip(x: str, low: str = "0", high: str = "1") -> str:
    return f"least({high}, greatest({low}, {x}))"


def smooth(low: str, high: str, x: str) -> str:
    t = clip(f"(({x}) - {low}) / ({high}::double - {low})")
    return f"(({t}) * ({t}) * (3 - 2 * ({t})))"


def srgb(x: str) -> str:
    x = clip(x)
    return f"case when {x} <= 0.0031308 then {x} * 12.92 else 1.055 * power({x}, 1 / 2.4::double) - 0.055 end"


def linear(x: str) -> str:
    x = f"greatest({x}, 0)"
    return f"case when {x} <= 0.04045 then {x} / 12.92 else power(({x} + 0.055) / 1.055, 2.4) end"


#: Hue in degrees, saturation and value of r, g and b, beside them.
HSV = (
    "r, g, b, greatest(r, g, b) as v, least(r, g, b) as _low, greatest(r, g, b) - _low as _d, "
    "case when _d <= 0 then 0 when v = r then 60 * ((g - b) / _d + case when g < b then 6 else 0 end) "
    "when v = g then 60 * ((b - r) / _d + 2) else 60 * ((r - g) / _d + 4) end as _h, "
    "_h - 360 * floor(_h / 360) as h, case when v > 0 then _d / v else 0 end as s"
)


def from_hsv(channel: str, h: str = "h", s: str = "s", v: str = "v") -> str:
    k = f"({ {'r': 5, 'g': 3, 'b': 1}[channel] } + {h} / 60.0::double)"
    k = f"({k} - 6 * floor({k} / 6))"
    return f"({v} - {v} * {s} * {clip(f'least({k}, 4 - {k})')})"


def brightness(b: float) -> list[str]:
    curve = f"sign(_y) * (_base + 1.06::double * _part / (_part + (1 - _part) * power(2, -0.95 * 1.2 * {b}))) * power(2, 0.05 * {b})"
    return [
        f"r, g, b, {luma()} as _y, floor(abs(_y) / 1.06::double) * 1.06::double as _base, (abs(_y) - _base) / 1.06::double as _part, {curve} as y1, _y as y0, "
        f"power(greatest(y1 / case when abs(_y) < 1e-5 then 1 else _y end, 0), 0.95 + (0.65 - 0.95) * {clip('y1', '0', '2')} * 0.5::double) / (1 + 2 * greatest(0, y1 - 0.9)) as chroma",
        each("case when abs(y0) < 1e-5 then {c} else y1 + ({c} - y0) * chroma end"),
    ]


def contrast(strength: str) -> str:
    p = "least(1, power(greatest({c}, 0), 1 / 2.2::double))"
    power = f"power(2, 1.25 * {strength})"
    curve = f"power(case when {p} < 0.5 then 0.5 * power(2 * {p}, {power}) else 1 - 0.5 * power(2 * (1 - {p}), {power}) end, 2.2)"
    return each(f"({curve}) + ({{c}} - ({curve})) * {smooth('1', '1.01', 'greatest({c}, 0)')}")


def saturation(s: str) -> str:
    return each(f"{luma()} + ({{c}} - {luma()}) * (1 + {s})")


TURNED = "0.9 * r + 0.1 * g + 0.05 * b as r1, 0.1 * r + 0.9 * g as g1, 0.95 * b as b1"
CALIBRATED = [
    f"{TURNED}, {luma('greatest(r1, 0)', 'greatest(g1, 0)', 'greatest(b1, 0)')} as y, r1 + g1 + b1 as _sum, case when _sum > 0.001 then (0.2 * r1 - 0.1 * b1) / _sum else 0 end as k",
    "r1 + (r1 - y) * k as r, g1 + (g1 - y) * k as g, b1 + (b1 - y) * k as b",
    f"1 - {smooth('0', '0.3', luma('greatest(r, 0)', 'greatest(g, 0)', 'greatest(b, 0)'))} as mask, r, g, b",
    each("{c} + {c} * {k} * mask", k="0.025 -0.025 0.025"),
]
TONE = rounded(*brightness(0.4), contrast("0.3"), *CALIBRATED)

VIBRANCE = [
    HSV,
    f"r, g, b, {luma()} as y, least(abs(h - 25), 360 - abs(h - 25)) as _away, v - least(r, g, b) as range, 3 * 0.4 * (1 - {smooth('0.4', '0.9', '(v - least(r, g, b)) / greatest(v, 0.001)')}) "
    f"* (1 - 0.4 * (1 - {smooth('10', '35', '_away')})) as amount",
    each("case when range < 0.02 then {c} else y + ({c} - y) * (1 + amount) end"),
]
HUE_TURNED = [each(srgb("{c}")), HSV, "h + 15 - 360 * floor((h + 15) / 360) as h, s, v", ", ".join(f"{linear(from_hsv(c))} as {c}" for c in "rgb")]
VIBRANCE_HUE = rounded(*VIBRANCE, *HUE_TURNED)

# Centre and width, in degrees, of the bands of the mixer.
BANDS = "(358, 35), (25, 45), (60, 40), (115, 90), (180, 60), (225, 60), (280, 55), (330, 50)"
_NEAR = "exp(-1.5 * power(least(abs(h - x.c), 360 - abs(h - x.c)) / (0.5 * x.w), 2))"
MIXED = [
    each("greatest({c}, 0)"),
    HSV,
    f"r, g, b, h, s, v, {luma()} as y, (select sum(case when x.c = 358 then {_NEAR} end) / sum({_NEAR}) from (values {BANDS}) x(c, w)) as near, {smooth('0.05', '0.2', 's')} as strong, {smooth('0', '1', 's')} as weight",
    f"r, g, b, s, strong, weight, y * (1 + 0.1 * near * weight) as target, h + 2 * 10 * near * strong as _t, _t - 360 * floor(_t / 360) as h1, {clip('s * (1 + 0.2 * near * strong)')} as s1, s * (1 + 0.2 * near * strong) as s2, v",
    "r, g, b, s2, strong, weight, target, " + ", ".join(f"{from_hsv(c, 'h1', 's1')} as {c}1" for c in "rgb"),
    f"{luma('r1', 'g1', 'b1')} as own, abs(r - g) < 0.001 and abs(g - b) < 0.001 or strong < 0.001 and weight < 0.001 as still, "
    + ", ".join(f"case when still then {c} when s2 < 0.0001 or own < 0.0001 then greatest(target, 0) else {c}1 * (target / own) end as _{c}, _{c} as {c}2" for c in "rgb"),
    ", ".join(f"{c}2 as {c}" for c in "rgb"),
    f"r, g, b, 1 - {smooth('0.0', '0.2', luma('greatest(r, 0)', 'greatest(g, 0)', 'greatest(b, 0)'))} as dark",
    each("{c} + {k} * 0.3 * 0.1 * dark + 0.05 * 0.5 * dark", k="-0.5 (1/6.0::double) 0.5"),
]
MIXER_GRADING = rounded(*MIXED)

#: Pieces of the curve: its ends, and the slopes there.
_PIECES = "piece as (select * from (values (0, 64, 0, 50, 50 / 64.0::double, 1.015625::double), (64, 192, 50, 210, 1.015625, (1.25 + 45 / 63.0::double) / 2), (192, 255, 210, 255, (1.25 + 45 / 63.0::double) / 2, 45 / 63.0::double)) p(x0, x1, y0, y1, m0, m1)), "


def _curve(c: str) -> str:
    t = f"(({c} * 255 - x0) / (x1 - x0)::double)"
    cubic = f"(2 * power({t}, 3) - 3 * power({t}, 2) + 1) * y0 + (power({t}, 3) - 2 * power({t}, 2) + {t}) * m0 * (x1 - x0) + (3 * power({t}, 2) - 2 * power({t}, 3)) * y1 + (power({t}, 3) - power({t}, 2)) * m1 * (x1 - x0)"
    inner = f"(select {clip(cubic, '0', '255')} from piece where {c} * 255 > x0 and {c} * 255 <= x1)"
    return f"case when {c} <= 0 then 0 when {c} >= 1 then 1 else {inner} / 255 end"


TONE_CURVE = rounded(each(_curve("{c}")), ctes=_PIECES)


def _lut(c: str) -> str:
    """The table's channels don't mix, so the way from corner to corner is a line in each of them."""
    low = f"floor({clip(c)} * 8)"
    value = lambda k: f"power(least({k}, 8) / 8.0::double, 0.9)"
    line = f"({value(low)} + ({value(low + ' + 1')} - {value(low)}) * ({clip(c)} * 8 - {low}))"
    return f"{c} + ({line} - {c}) * 0.8"


LUT = rounded(each(_lut("{c}")))

_FAR = "sqrt(power((pos % 4) / 2.0::double - 1, 2) + power((pos // 4) / 2.0::double - 1, 2)) * 0.5"


def vignette(amount: str) -> str:
    return each(f"{{c}} * (1 - {amount} * {smooth('0.249999999', '0.750000001', _FAR)})")


VIGNETTE = rounded(vignette("0.5"))

_RAW = "power({s}, 1 / 1.1::double)"


def _raw_tones(c: str) -> str:
    t = _RAW.format(s=f"({srgb(c)})")
    return f"{t} + ({t} * {t} * (3 - 2 * {t}) - {t}) * 0.75"


GRADE = rounded(each("{c} * power(2, (length(path) % 3) / 10.0::double / 0.8)"), contrast("0.2"), saturation("0.1"), vignette("0.2"), each(_raw_tones("{c}")))

_EDGE = "filter (where pos // 4 in (0, 3)) over (partition by path)"
_BEND = "(1 / (1 + exp(-4 * ({x} - 0.6))))"


def _positive(c: str) -> str:
    x = f"greatest(0, ({c} - {c}_low) / case when {c}_high <= {c}_low + 0.0001 then 1 else {c}_high - {c}_low end)"
    zero, one = _BEND.format(x="0"), _BEND.format(x="1")
    return clip(f"({_BEND.format(x=x)} - {zero}) / ({one} - {zero})")


NEGATIVE = rounded(
    each("-log10(least(1, greatest(1e-6, {c})))"),
    "r, g, b, " + ", ".join(f"min({c}) {_EDGE} as {c}_low, max({c}) {_EDGE} as {c}_high" for c in "rgb"),
    each(_positive("{c}")),
    f"r, g, b, {luma()} as y, power({clip('(greatest(r, g, b) - 0.9) * 10')}, 2) as over_",
    each(f"power({clip('{c} + (y - {c}) * over_')}, 1 / 2.2::double)"),
)

MASKS = (
    chain(
        "sqrt(power(r - 0.5, 2) + power(g - 0.5, 2) + power(b - 0.5, 2)) as _far, trunc(255 * greatest(0, 1 - 255 * _far / (76.5 * sqrt(3)))) as near, "
        f"abs({luma()} - {luma('0.6', '0.4', '0.5')}) as _dark, trunc(255 * greatest(0, 1 - 255 * _dark / 51)) as light"
    )
    + ", m as (select path, pos, cast(greatest(0, round(near * 0.8) - round((255 - light) * 0.8)) as int) as v from s1) select path, string_agg(cast(v as varchar), ',' order by pos) as mask from m group by path"
)

FOCUS_STACK = (
    chain(f"cast(regexp_extract(path, '([0-9]+)$', 1) as int) as n, pos // 4 as y, pos % 4 as x, {luma()} as l")
    + ", near as (select a.n, a.y, a.x, abs(4 * a.l - u.l - d.l - w.l - e.l) as score from s1 a join s1 u on u.n = a.n and u.x = a.x and u.y = greatest(a.y - 1, 0) join s1 d on d.n = a.n and d.x = a.x and d.y = least(a.y + 1, 3) "
    "join s1 w on w.n = a.n and w.y = a.y and w.x = greatest(a.x - 1, 0) join s1 e on e.n = a.n and e.y = a.y and e.x = least(a.x + 1, 3)), "
    "tiles as (select n // 4 as stack, n % 4 as frame, y // 2 * 2 as y, x // 2 * 2 as x, avg(score) as score from near group by all), "
    "best as (select *, row_number() over (partition by stack, y, x order by score desc, frame) as place from tiles) "
    "select cast(stack as varchar) as stack, cast(y as int) as y, cast(x as int) as x, cast(frame as int) as frame from best where place = 1"
)

_LUMA8 = "cast(least(255, (r * 218 + g * 732 + b * 74) >> 10) as int)"
#: Counts of every second pixel, spread over 13 bins; a tap that would leave the range reads the bin at the end.
HISTOGRAM = (
    f"with {RGB_SQL}, c as (select path, unnest(['red', 'green', 'blue', 'luma']) as channel, unnest([r, g, b, {_LUMA8}]) as src from rgb where pos % 2 = 0), n as (select path, channel, src, count(*) as n from c group by all), "
    "taps as (select k, exp(-(k * k) / 8.0::double) as w from range(-6, 7) t(k)), kernel as (select b.bin, least(255, greatest(0, b.bin + k)) as src, sum(w) / (select sum(w) from taps) as w from range(256) b(bin), taps group by all), "
    "hit as (select path, channel, bin, sum(n * w) as v from n join kernel using (src) group by all), every as (select p.path, p.channel, b.bin, coalesce(h.v, 0) as v from (select distinct path, channel from n) p cross join range(256) b(bin) left join hit h on h.path = p.path and h.channel = p.channel and h.bin = b.bin), "
    "top as (select path, channel, list_sort(list(v))[253] as t from every group by all) select path, channel, cast(bin as int) as bin, round(case when t > 1e-6 then least(v / t, 1) else 0 end, 6) as value from every join top using (path, channel)"
)

#: Temperature and tint by path; images with fewer than 16 pixels to judge by stay as they are.
WHITE_BALANCE_CTE = (
    f"unit as (select path, r / 255.0::double as r, g / 255.0::double as g, b / 255.0::double as b from rgb), judged as (select *, greatest(r, g, b) as top, {luma()} as y, (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b, 1e-6) as s, "
    "count(*) over (partition by path) as n from unit where least(r, g, b) > 0 and greatest(r, g, b) <= 0.98 and " + luma() + " >= 0.08), "
    "ranked as (select *, floor(s * 255 + 0.5) as step, count(*) over (partition by path order by floor(s * 255 + 0.5)) as upto from judged where n >= 16), "
    "limits as (select path, least(0.72, greatest(0.08, min(step) filter (where upto >= ceil(n * 0.35::double)) / 255.0::double)) as most from ranked group by path), "
    f"own as (select j.*, power(1 - s, 3) * {clip('y / 0.6::double', '0.2', '1')} as w from ranked j join limits using (path) where s <= most), "
    "ratio as (select path, least(1, greatest(-1, sum(ln(g / greatest(r, 1 / 255.0::double)) * w) / sum(w))) as red, least(1, greatest(-1, sum(ln(g / greatest(b, 1 / 255.0::double)) * w) / sum(w))) as blue from own group by path having sum(w) > 1e-6), "
    "gains as (select t, n, ln((1 + 0.2 * t / 25.0::double) * (1 + 0.25 * n / 100.0::double) / ((1 + 0.05 * t / 25.0::double) * (1 - 0.25 * n / 100.0::double))) as red, "
    "ln((1 - 0.2 * t / 25.0::double) * (1 + 0.25 * n / 100.0::double) / ((1 + 0.05 * t / 25.0::double) * (1 - 0.25 * n / 100.0::double))) as blue from range(-85, 86) a(t), range(-85, 86) b(n)), "
    "best as (select path, arg_min({t: gains.t, n: gains.n}, power(gains.red - ratio.red, 2) + power(gains.blue - ratio.blue, 2)) as x from ratio, gains group by path), "
    "wb as (select p.path, coalesce(cast(x.t as double), 0) as temperature, coalesce(cast(x.n as double), 0) as tint from (select distinct path from rgb) p left join best using (path))"
)
WHITE_BALANCE = f"with {RGB_SQL}, {WHITE_BALANCE_CTE} select path, temperature, tint from wb"


def _place(share: str, column: str) -> str:
    """The least value that this share of the pixels, cut to a whole number of them, doesn't exceed; 0 if that number is 0."""
    return f"case when floor(16 * {share}) = 0 then 0 else list_sort(list({column}))[cast(floor(16 * {share}) as int)] end"


AUTO_ADJUST = (
    f"with {RGB_SQL}, {WHITE_BALANCE_CTE}, px as (select path, pos, round({luma()}, 6) as y, least(255, floor(y + 0.5)) as bin, (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b, 1)::double as s, pos % 4 in (1, 2) and pos // 4 in (1, 2) as middle from rgb), "
    f"st as (select path, {_place('0.01', 'bin')} as p1, {_place('0.5', 'bin')} as p50, {_place('0.99', 'bin')} as p99, avg(s) as sat, count(*) filter (bin >= 240) / 16.0::double as bright, count(*) filter (bin >= 250) / 16.0::double as clipped, count(*) filter (bin < 32) / 16.0::double as dark, "
    "(avg(y) filter (middle) - avg(y) filter (not middle)) / 255 as ahead from px group by path), "
    "e as (select *, greatest(1, p99 - p1) as spread, least((128 - p50) * 0.125, case when p99 > 245 or bright > 0.02 or clipped > 0.005 then 0 else 1000 end, 250 - p99) as exposure, "
    "case when spread < 220 then (220 / spread::double - 1) * 10 * case when bright > 0.02 then 0.5 else 1 end else 0 end as contrast from st), "
    f"sh as (select path, floor({clip('(y + exposure - 128) * (1 + contrast / 100) + 128', '0', '255')} + 0.5) as bin from px join e using (path)), af as (select path, {_place('0.01', 'bin')} as a1, {_place('0.5', 'bin')} as a50, {_place('0.99', 'bin')} as a99 from sh group by path), "
    "v as (select path, unnest(['exposure', 'brightness', 'contrast', 'highlights', 'shadows', 'vibrance', 'vignetteAmount', 'temperature', 'tint', 'dehaze', 'clarity', 'centré', 'whites', 'blacks']) as setting, "
    "unnest([exposure / 20.0::double, (128 - a50) * 0.007::double, contrast, case when bright > 0.02 then -least(bright * 120, 70) else 0 end, case when dark > 0.05 then least(dark * 40, 50) else 0 end, case when sat < 0.2 then (0.2 - sat) * 120 else 0 end, case when ahead > 0 then -ahead * 100 else 0 end, "
    "temperature, tint, case when spread < 120 and sat < 0.15 then (1 - spread / 120.0::double) * 35 else 0 end, case when spread < 180 then (1 - spread / 180.0::double) * 50 else 0 end, case when ahead > 0.05 then least(ahead * 100, 60) else 0 end, (a99 - 255) * 0.2::double, -a1 * 0.5::double]) as value "
    "from e join af using (path) join wb using (path)) select path, setting, round(case when setting in ('exposure', 'brightness') then least(5, greatest(-5, value)) else least(100, greatest(-100, value)) end, 6) as value from v"
)

#: Counts of each job, one event after the other; they start anew after an event that completes.
JOB_PROGRESS = (
    'with recursive e as (select user_id as job_id, event_id as "at", case when event_id % 3 = 0 then 2 else 0 end as added, case when event_id % 3 = 0 then 0 else 1 end as done, row_number() over (partition by user_id order by event_id, event_id % 3) as n from events), '
    'k(job_id, n, "at", total, done) as (select job_id, n, "at", added, done from e where n = 1 union all select e.job_id, e.n, e."at", case when k.total > 0 and k.done >= k.total then 0 else k.total end + e.added, case when k.total > 0 and k.done >= k.total then 0 else k.done end + e.done from k join e on e.job_id = k.job_id and e.n = k.n + 1) '
    'select cast(job_id as bigint) as job_id, cast("at" as bigint) as "at", cast(done as bigint) as completed from k where total > 0 and done >= total'
)
