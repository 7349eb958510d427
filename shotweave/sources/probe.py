"""Probe output (JSON text per file) as source rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shotweave import schema as S
from shotweave.functions import expr as X


def _number(c):
    return F.when((c != "") & (c != "N/A"), c.try_cast("double"))


def parse_probe(df: DataFrame, json_col: str = "probe") -> DataFrame:
    """Add the source columns read from a probe document: the first video and the first audio stream.

    ``probed`` is false when there is no video stream; the other columns are null then.
    """
    d = df.withColumn("__d", F.from_json(json_col, S.PROBE_DOC))

    def first(kind):
        return F.get(F.filter("__d.streams", lambda s: s["codec_type"] == kind), F.lit(0))

    d = d.withColumns({"__v": first("video"), "__a": first("audio")})
    v, a = F.col("__v"), F.col("__a")
    rate = F.coalesce(v["r_frame_rate"], F.lit("0/1"))
    parts = F.split(rate, "/")
    fps = F.when(F.size(parts) == 2, F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")))
    fps = F.when(F.coalesce(fps, F.lit(0.0)) <= 0, F.lit(24.0)).otherwise(fps)
    tb_num = F.substring_index(v["time_base"], "/", 1).try_cast("long")
    tb_den = F.regexp_extract(v["time_base"], r"^[^/]*/(.*)$", 1).try_cast("long")
    tb_ok = tb_num.isNotNull() & tb_den.isNotNull()
    d = d.withColumns({
        "probed": v.isNotNull(), "__fps": F.when(v.isNotNull(), fps),
        "__dur": F.coalesce(_number(v["duration"]), _number(F.col("__d.format.duration")), F.lit(0.0))})
    nb = F.when(v["nb_frames"] != "N/A", v["nb_frames"].try_cast("long"))
    frames = F.when(F.coalesce(nb, F.lit(0)) != 0, nb).otherwise(F.greatest((F.col("__dur") * F.col("__fps")).cast("long"), F.lit(0)))

    def given(c):
        return F.when(v.isNotNull(), c)

    zero = F.lit(0)
    out = {
        "width": given(F.coalesce(v["width"].try_cast("int"), zero)), "height": given(F.coalesce(v["height"].try_cast("int"), zero)),
        "total_frames": given(frames.cast("long")), "fps": F.col("__fps"), "duration_seconds": given(F.col("__dur")),
        "codec": given(F.coalesce(v["codec_name"], F.lit("unknown"))),
        "audio_codec": given(F.coalesce(a["codec_name"], F.lit(""))),
        "audio_sample_rate": given(F.coalesce(a["sample_rate"].try_cast("int"), zero)),
        "audio_channels": given(F.coalesce(a["channels"].try_cast("int"), zero)),
        "time_base_num": given(F.when(tb_ok, tb_num).otherwise(zero.cast("long"))),
        "time_base_den": given(F.when(tb_ok, tb_den).otherwise(zero.cast("long"))),
        "hdr": X.is_hdr(v["color_transfer"], v["color_primaries"]),
    }
    return d.select(*df.columns, "probed", *[c.alias(n) for n, c in out.items()])
