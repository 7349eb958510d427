"""Scalar column functions: rates, times, names, geometry. All stay inside JVM code generation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# ---- fixed values ---------------------------------------------------------------
OUTPUT_FRAMES = 81
OUTPUT_FPS = 16
AUDIO_RATE = 48000
NTSC_RATES = [(24000, 1001), (30000, 1001), (60000, 1001)]
ASPECT_PRESETS = {"1:1": (1, 1), "4:3": (4, 3), "16:9": (16, 9), "9:16": (9, 16), "3:4": (3, 4)}
FORMAT_SUFFIXES = [
    (24000 / 1001, "2398"), (24.0, "24"), (25.0, "25"), (30000 / 1001, "2997"),
    (30.0, "30"), (50.0, "50"), (60000 / 1001, "5994"), (60.0, "60"),
]
VERSION_TRIGGERS = [
    "autosave", "manual", "pre_detect_cuts", "pre_multi_delete",
    "pre_group_delete", "pre_source_removal", "pre_restore",
]
MEDIA_EXTENSIONS = ["mp4", "mkv", "avi", "mov", "wmv", "flv", "webm", "m4v", "ts", "mxf"]
H264_CODECS = ["h264", "avc", "avc1"]
SIZE_FACTORS = {"prores_proxy": 0.09, "prores_lt": 0.21, "prores_standard": 0.30, "prores_hq": 0.44}
SIZE_FACTOR_DEFAULT = 0.30
HDR_TRANSFERS = ["smpte2084", "arib-std-b67"]
HDR_PRIMARIES = "bt2020"
INTERPS = ["linear", "bezier", "step"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else (x if isinstance(x, Column) else F.lit(x))


def _long(x) -> Column:
    return _c(x).cast("long")


def div(a, b) -> Column:
    """Integer division of longs (truncating; operands are never negative here)."""
    return F.call_function("div", _long(a), _long(b))


def rounded(x) -> Column:
    """Half-to-even rounding to a long."""
    return F.rint(_c(x)).cast("long")


# ---- rates and times --------------------------------------------------------------

def _near(fps: Column, rate: float, tol: float) -> Column:
    return F.abs(fps - F.lit(rate)) < tol


def frame_duration(fps) -> Column:
    """Exact duration of one frame as ``struct(num, den)`` seconds."""
    fps = _c(fps)

    def pair(n, d):
        return F.struct(_long(n).alias("num"), _long(d).alias("den"))

    out = F.when(fps <= 0, pair(100, 2400))
    for n, d in NTSC_RATES:
        out = out.when(_near(fps, n / d, 0.01), pair(d, n))
    out = out.when(F.abs(fps - F.rint(fps)) < 0.001, pair(100, rounded(fps) * 100))
    return out.otherwise(pair(1000, rounded(fps * 1000)))


def is_ntsc(fps) -> Column:
    fps = _c(fps)
    out = F.lit(False)
    for n, d in NTSC_RATES:
        out = out | _near(fps, n / d, 0.01)
    return out


def is_seek_safe(tb_num, tb_den, fps) -> Column:
    """Can a container clock of tb_num/tb_den tick every frame exactly? Unknown clocks count as safe."""
    n, d = _long(tb_num), _long(tb_den)
    fd = frame_duration(fps)
    unknown = F.coalesce((n <= 0) | (d <= 0), F.lit(True))
    ticks = F.when(~unknown, F.pmod(fd["num"] * d, fd["den"] * n) == 0)
    return F.when(unknown, True).otherwise(ticks)


def duration_seconds(total_frames, fps) -> Column:
    fps = _c(fps)
    return F.when(fps > 0, _c(total_frames) / fps).otherwise(F.lit(0.0))


def seek_ts(frame, fps) -> Column:
    """Timestamp half a frame early, so a time seek never lands past the wanted frame."""
    frame, fps = _c(frame), _c(fps)
    return F.when((frame <= 0) | (fps <= 0), F.lit(0.0)).otherwise((frame - 0.5) / fps)


def exact_samples(frames, fps, rate=AUDIO_RATE) -> Column:
    """Audio samples covering ``frames``; rational arithmetic for the fractional broadcast rates."""
    frames, fps, rate = _long(frames), _c(fps), _long(rate)
    out = F.when((frames <= 0) | (fps <= 0), _long(0))
    for n, d in NTSC_RATES:
        out = out.when(_near(fps, n / d, 1e-3), div(frames * rate * d, n))
    return out.otherwise(rounded(frames * rate / fps))


def window_samples(rate=AUDIO_RATE) -> Column:
    return div(_long(rate) * OUTPUT_FRAMES, OUTPUT_FPS)


def required_frames(fps) -> Column:
    """Source frames one fixed-length export window consumes."""
    fps = _c(fps)
    return F.when(fps <= 0, _long(OUTPUT_FRAMES)).otherwise(
        F.ceil(F.lit(OUTPUT_FRAMES) * fps / F.lit(OUTPUT_FPS)).cast("long"))


def can_host(source_id, source_in, source_out, fps) -> Column:
    span = _long(source_out) - _long(source_in) + 1
    return _c(source_id).isNotNull() & (span >= required_frames(fps))


def clamp_anchor(anchor, source_id, source_in, source_out, fps) -> Column:
    """Anchor moved into the legal range of its clip; untouched on gaps and on clips that are too short."""
    anchor, lo = _long(anchor), _long(source_in)
    hi = _long(source_out) - required_frames(fps) + 1
    fixed = _c(source_id).isNull() | (hi < lo)
    return F.when(fixed, anchor).otherwise(F.least(F.greatest(anchor, lo), hi))


def time_str(frames, num, den) -> Column:
    frames = _long(frames)
    return F.when(frames == 0, F.lit("0s")).otherwise(
        F.concat((frames * _long(num)).cast("string"), F.lit("/"), _long(den).cast("string"), F.lit("s")))


def src_seek_str(frame, num, den) -> Column:
    """Source position text, shifted by half a frame so that rounding readers keep the frame."""
    frame, num = _long(frame), _long(num)
    return F.when(frame <= 0, F.lit("0s")).otherwise(
        F.concat((frame * num + div(num, 2)).cast("string"), F.lit("/"), _long(den).cast("string"), F.lit("s")))


def otio_start(frame) -> Column:
    return _long(frame).cast("double") + F.lit(0.25)


def parse_fraction(text) -> Column:
    """"a/bs", "as" or "0s" → struct(num, den, error)."""
    t = F.trim(_c(text))
    body = F.regexp_extract(t, r"^(.*)s$", 1)
    slash = F.instr(body, "/") > 0
    num = F.trim(F.substring_index(body, "/", 1)).try_cast("long")
    den = F.when(slash, F.trim(F.regexp_replace(body, r"^[^/]*/", "")).try_cast("long")).otherwise(_long(1))
    ok = t.endswith("s") & num.isNotNull() & den.isNotNull()
    zero = t == "0s"
    return F.struct(
        F.when(zero, _long(0)).when(ok, num).alias("num"),
        F.when(zero, _long(1)).when(ok, den).alias("den"),
        F.when(~F.coalesce(zero | ok, F.lit(False)),
               F.concat(F.lit("unexpected time string: "), F.coalesce(t, F.lit("null")))).alias("error"),
    )


def fps_suffix(fps) -> Column:
    fps = _c(fps)
    out = None
    for rate, name in FORMAT_SUFFIXES:
        cond = _near(fps, rate, 0.01)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(rounded(fps).cast("string"))


def rational_rate(fps, max_den: int = 100000) -> Column:
    """Closest fraction to ``fps`` with a bounded denominator, as ``struct(num, den)``.

    Continued-fraction expansion as a fold; the last step may take a partial quotient so that the
    denominator stays within the bound, and the nearer of the two candidates wins.
    """
    x = _c(fps).cast("double")
    # The fold is over a fixed list of steps; state = previous and current convergent.
    state = F.struct(
        _long(0).alias("p0"), _long(1).alias("q0"), _long(1).alias("p1"), _long(0).alias("q1"),
        x.alias("r"), F.lit(False).alias("done"), _long(0).alias("k"),
    )

    def step(s, _):
        a = F.floor(s["r"]).cast("long")
        q2 = s["q0"] + a * s["q1"]
        p2 = s["p0"] + a * s["p1"]
        over = q2 > max_den
        frac = s["r"] - a
        k = F.when(over & (s["q1"] > 0), div(_long(max_den) - s["q0"], F.greatest(s["q1"], _long(1)))).otherwise(_long(0))
        stop = F.struct(s["p0"].alias("p0"), s["q0"].alias("q0"), s["p1"].alias("p1"), s["q1"].alias("q1"),
                        s["r"].alias("r"), F.lit(True).alias("done"), k.alias("k"))
        go = F.struct(s["p1"].alias("p0"), s["q1"].alias("q0"), p2.alias("p1"), q2.alias("q1"),
                      F.when(frac > 1e-9, 1.0 / frac).otherwise(F.lit(0.0)).alias("r"),
                      (frac <= 1e-9).alias("done"), _long(0).alias("k"))
        return F.when(s["done"], s).when(over, stop).otherwise(go)

    def finish(s):
        bp, bq = s["p0"] + s["k"] * s["p1"], s["q0"] + s["k"] * s["q1"]
        semi = (s["k"] > 0) & (bq > 0) & (F.abs(bp / F.greatest(bq, _long(1)) - x) < F.abs(s["p1"] / F.greatest(s["q1"], _long(1)) - x))
        return F.struct(F.when(semi, bp).otherwise(s["p1"]).alias("num"),
                        F.when(semi, bq).otherwise(s["q1"]).alias("den"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(24)), state, step, finish)


def pts_to_frame(pts, tb_num, tb_den, fps_num, fps_den) -> Column:
    """int(pts · time base · fps + 1/10) in exact arithmetic; a missing pts gives −1."""
    def big(x):
        return _long(x).cast("decimal(19,0)")

    def wide(x):
        return x.cast("decimal(38,0)")

    scale = wide(big(tb_den) * big(fps_den))
    top = wide(wide(big(pts) * big(tb_num)) * wide(_long(fps_num).cast("decimal(10,0)") * F.lit(10).cast("decimal(2,0)"))) + scale
    value = F.call_function("div", wide(top), wide(scale * F.lit(10).cast("decimal(2,0)")))
    return F.when(_c(pts).isNull(), _long(-1)).otherwise(value.cast("long"))


# ---- descriptions ------------------------------------------------------------------

def _strip_zeros(text: Column) -> Column:
    return F.regexp_replace(text, r"\.?0+$", "")


def khz_text(rate) -> Column:
    """Sample rate in kHz with at most six significant digits and no trailing zeros."""
    khz = _c(rate) / F.lit(1000.0)
    return (F.when(khz < 1e3, _strip_zeros(F.format_string("%.3f", khz)))
            .when(khz < 1e4, _strip_zeros(F.format_string("%.2f", khz)))
            .when(khz < 1e5, _strip_zeros(F.format_string("%.1f", khz)))
            .otherwise(F.format_string("%.0f", khz)))


def time_base_text(num, den) -> Column:
    num, den = _long(num), _long(den)
    return F.when((num <= 0) | (den <= 0) | num.isNull() | den.isNull(), F.lit("")).otherwise(
        F.concat(num.cast("string"), F.lit("/"), den.cast("string")))


def audio_text(codec, channels, rate) -> Column:
    codec, channels, rate = _c(codec), _c(channels), _c(rate)
    parts = F.concat_ws(
        ", ", F.when(codec != "", codec), F.concat(channels.cast("string"), F.lit(" ch")),
        F.when(rate > 0, F.concat(khz_text(rate), F.lit(" kHz"))))
    return F.when(F.coalesce(channels, F.lit(0)) > 0, parts).otherwise(F.lit("none"))


def is_hdr(transfer, primaries) -> Column:
    return F.coalesce(_c(transfer).isin(*HDR_TRANSFERS) & (_c(primaries) == HDR_PRIMARIES), F.lit(False))


def media_class(codec, width, height, hdr=None) -> Column:
    hdr = F.coalesce(_c(hdr), F.lit(False)) if hdr is not None else F.lit(False)
    heavy = ~F.lower(F.coalesce(_c(codec), F.lit(""))).isin(*H264_CODECS) | (_c(width) >= 3000) | (_c(height) >= 1800) | hdr
    return F.when(heavy, "heavy").otherwise("light")


def estimate_bytes(codec_key, frames, width, height, samples) -> Column:
    """struct(export_bytes, audio_bytes, total_bytes): the export with its audio, plus the raw audio extract."""
    factor = F.lit(SIZE_FACTOR_DEFAULT)
    key = _c(codec_key)
    for name, f in SIZE_FACTORS.items():
        factor = F.when(key == name, f).otherwise(factor)
    audio = (_long(samples) * 4).cast("double")
    video = _c(frames) * (_long(width) * _long(height) / F.lit(1000000.0)) * factor * F.lit(1048576.0) + audio
    return F.struct(video.alias("export_bytes"), audio.alias("audio_bytes"), (video + audio).alias("total_bytes"))


# ---- names and paths --------------------------------------------------------------

def basename(path) -> Column:
    return F.regexp_replace(_c(path), r"^.*[/\\\\]", "")


def basename_ci(path) -> Column:
    return F.lower(basename(path))


def drop_extension(name) -> Column:
    """Without the last extension; leading dots belong to the name."""
    return F.regexp_replace(_c(name), r"^(\.*[^./\\\\][^/\\\\]*|.*[/\\\\]\.*[^./\\\\][^/\\\\]*)\.[^./\\\\]*$", "$1")


def stem(path) -> Column:
    s = drop_extension(basename(path))
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit("source")).otherwise(s)


def folder_slug(text) -> Column:
    t = F.coalesce(_c(text), F.lit(""))
    clean = F.regexp_replace(F.trim(F.regexp_replace(t, r"[^A-Za-z0-9 _\-]+", "_")), r"\s+", "_")
    return F.when(clean == "", F.lit("_untagged")).otherwise(clean)


def label_slug(text) -> Column:
    s = F.regexp_replace(F.lower(F.trim(_c(text))), r"[^a-z0-9]+", "-")
    return F.left(F.regexp_replace(s, r"^-+|-+$", ""), F.lit(40))


def _quote(part: Column) -> Column:
    q = F.url_encode(part)
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        q = F.replace(q, F.lit(old), F.lit(new))
    return q


def file_uri(path) -> Column:
    """file:// text of an absolute path; drive letters keep their colon."""
    p = F.replace(_c(path), F.lit("\\"), F.lit("/"))
    drive = F.regexp_extract(p, r"^([A-Za-z]:)/", 1)
    return F.when(drive != "", F.concat(F.lit("file:///"), drive, _quote(F.regexp_replace(p, r"^[A-Za-z]:", "")))) \
        .otherwise(F.concat(F.lit("file://"), _quote(p)))


def crop_job_name(source_stem, anchor, out_w, out_h, crop_id, segment_id) -> Column:
    return F.format_string(
        "%s_f%d_%dx%d_%s_%s", _c(source_stem), _long(anchor), _long(out_w), _long(out_h),
        F.left(_c(crop_id).cast("string"), F.lit(6)), F.left(_c(segment_id).cast("string"), F.lit(4)))


def is_media_path(path) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(basename(path), r"[^.]\.([^.]*)$", 1)).isin(*MEDIA_EXTENSIONS), F.lit(False))


def parse_version_name(name, extension: str = "project") -> Column:
    """struct(matched, ts, trigger, label) of a snapshot file name."""
    n = _c(name)
    pattern = r"(?i)^(\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2})(?:_([a-z0-9_-]+))?\." + extension + "$"
    ts = F.try_to_timestamp(F.regexp_extract(n, pattern, 1), F.lit("yyyy-MM-dd_HH-mm-ss")).cast("timestamp_ntz")
    guess = F.replace(F.regexp_extract(n, pattern, 2), F.lit("-"), F.lit("_"))
    return F.struct(
        ts.isNotNull().alias("matched"), ts.alias("ts"),
        F.when(ts.isNotNull(), F.when(guess.isin(*VERSION_TRIGGERS), guess).otherwise(F.lit("manual"))).alias("trigger"),
        F.lit(None).cast("string").alias("label"))


# ---- geometry -----------------------------------------------------------------------

def resolve_aspect(aspect, custom_w, custom_h) -> Column:
    """struct(num, den) of the ratio lock, null when there is none."""
    aspect, cw, ch = _c(aspect), _long(custom_w), _long(custom_h)

    def pair(n, d):
        return F.struct(_long(n).alias("num"), _long(d).alias("den"))

    out = F.when((aspect == "custom") & (cw > 0) & (ch > 0), pair(cw, ch))
    for name, (n, d) in ASPECT_PRESETS.items():
        out = out.when(aspect == name, pair(n, d))
    return out


def to_even(value) -> Column:
    return F.greatest(_long(2), F.rint(_c(value) / F.lit(2.0)).cast("long") * 2)


def crop_output_dims(w, h, base_w, base_h, out_width) -> Column:
    """struct(out_w, out_h) for a wanted width, keeping the ratio of the sampled rectangle."""
    w, h, bw, bh = _long(w), _long(h), _long(base_w), _long(base_h)
    bad = (w <= 0) | (h <= 0)

    def or_one(x):
        return F.when(F.coalesce(x, _long(0)) == 0, _long(1)).otherwise(x)

    w2 = F.when(bad, or_one(bw)).otherwise(w)
    h2 = F.when(bad, or_one(bh)).otherwise(h)
    return F.struct(to_even(out_width).alias("out_w"), to_even(_c(out_width) * h2 / w2).alias("out_h"))


def clamp_rect(mode: str, x, y, w, h, frame_w, frame_h, min_size: int = 8) -> Column:
    """struct(x, y, w, h) after the bounds rule of one editing mode: draw, move or render."""
    x, y, w, h, fw, fh = (_long(v) for v in (x, y, w, h, frame_w, frame_h))

    def between(v, lo, hi):
        return F.greatest(lo, F.least(hi, v))

    if mode == "draw":
        m = _long(min_size)
        nx, ny = between(x, _long(0), fw - m), between(y, _long(0), fh - m)
        nw, nh = between(w, m, fw - nx), between(h, m, fh - ny)
    elif mode == "move":
        nx, ny, nw, nh = between(x, _long(0), fw - w), between(y, _long(0), fh - h), w, h
    elif mode == "render":
        two = _long(2)
        nx, ny = between(x, _long(0), fw - 2), between(y, _long(0), fh - 2)
        nw, nh = between(w, two, fw - nx), between(h, two, fh - ny)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return F.struct(nx.alias("x"), ny.alias("y"), nw.alias("w"), nh.alias("h"))


def default_rect(frame_w, frame_h) -> Column:
    """Centred half-size rectangle of at least 16 pixels a side."""
    fw, fh = F.greatest(_long(1), _long(frame_w)), F.greatest(_long(1), _long(frame_h))
    w, h = F.greatest(_long(16), div(fw, 2)), F.greatest(_long(16), div(fh, 2))
    # floor division: a frame under 16 pixels makes the margin negative
    x, y = F.floor((fw - w) / 2).cast("long"), F.floor((fh - h) / 2).cast("long")
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))
