"""Explicit schemas of the library's tables and of the documents it reads."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _struct(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols.items()])


SOURCES = _struct(
    source_id=_S, file_path=_S, total_frames=_L, fps=_D, width=_I, height=_I, codec=_S,
    audio_codec=_S, audio_sample_rate=_I, audio_channels=_I, time_base_num=_L, time_base_den=_L,
)
ITEMS = _struct(
    timeline_id=_S, item_ix=_L, clip_id=_S, source_id=_S, source_in=_L, source_out=_L,
    label=_S, color_index=_I, group_ids=T.ArrayType(_S),
)
TIMELINES = _struct(timeline_id=_S, in_point=_L, out_point=_L)
GROUPS = _struct(timeline_id=_S, group_id=_S, name=_S, color=_S, digit=_I, group_ix=_L)
CROPS = _struct(
    timeline_id=_S, clip_id=_S, crop_ix=_L, crop_id=_S, x=_L, y=_L, w=_L, h=_L, aspect_ratio=_S,
    custom_ratio_w=_L, custom_ratio_h=_L, group_id=_S, active=_B, label=_S,
)
SEGMENTS = _struct(timeline_id=_S, crop_id=_S, segment_ix=_L, segment_id=_S, anchor_frame=_L, active=_B)
KEYFRAMES = _struct(
    timeline_id=_S, crop_id=_S, axis=_S, source_frame=_L, value=_D, interp=_S, in_dx=_D, in_dy=_D, out_dx=_D, out_dy=_D,
)
ORPHANS = _struct(timeline_id=_S, file_path=_S, source_id=_S)
VERSIONS = _struct(
    filename=_S, timestamp=_S, trigger=_S, label=_S, clip_count=_L, source_count=_L, size_bytes=_L,
)

# ---- nested project document ------------------------------------------------

KEY_DOC = _struct(
    source_frame=_L, value=_D, interp=_S, in_handle=T.ArrayType(_D), out_handle=T.ArrayType(_D),
)
TRACK_DOC = _struct(keys=T.ArrayType(KEY_DOC))
SEGMENT_DOC = _struct(id=_S, anchor_frame=_L, active=_B)
CROP_DOC = _struct(
    id=_S, x=_L, y=_L, w=_L, h=_L, segments=T.ArrayType(SEGMENT_DOC), aspect_ratio=_S,
    custom_ratio_w=_L, custom_ratio_h=_L, group_id=_S, active=_B, label=_S,
    x_track=TRACK_DOC, y_track=TRACK_DOC, w_track=TRACK_DOC, h_track=TRACK_DOC,
    anchor_frame=_L,  # layout before segments existed
)
CLIP_DOC = _struct(
    id=_S, source_id=_S, source_in=_L, source_out=_L, label=_S, color_index=_I,
    group_ids=T.ArrayType(_S), crop_regions=T.ArrayType(CROP_DOC),
)
SOURCE_DOC = _struct(
    id=_S, file_path=_S, relative_path=_S, total_frames=_L, fps=_D, width=_I, height=_I, codec=_S,
    audio_codec=_S, audio_sample_rate=_I, audio_channels=_I, time_base_num=_L, time_base_den=_L,
)
GROUP_DOC = _struct(id=_S, name=_S, color=_S, digit=_I)
PROJECT_DOC = _struct(
    version=_I, playhead_position=_L, scroll_offset=_L, pixels_per_frame=_D,
    selection_follows_playhead=_B, in_point=_L, out_point=_L,
    sources=T.ArrayType(SOURCE_DOC), clips=T.ArrayType(CLIP_DOC), groups=T.ArrayType(GROUP_DOC),
    orphan_paths=T.MapType(_S, _S),
    broken=_S,  # the whole text of a document that does not parse
)

# ---- probe output -------------------------------------------------------------

PROBE_DOC = _struct(
    streams=T.ArrayType(_struct(
        codec_type=_S, codec_name=_S, width=_S, height=_S, time_base=_S, nb_frames=_S,
        r_frame_rate=_S, avg_frame_rate=_S, duration=_S, sample_rate=_S, channels=_S,
        color_transfer=_S, color_primaries=_S,
    )),
    format=_struct(duration=_S),
)

# ---- timeline interchange document ---------------------------------------------

_RATIONAL = _struct(OTIO_SCHEMA=_S, rate=_D, value=_D)
_RANGE = _struct(OTIO_SCHEMA=_S, duration=_RATIONAL, start_time=_RATIONAL)
OTIO_CHILD = _struct(
    OTIO_SCHEMA=_S, name=_S, source_range=_RANGE,
    media_references=_struct(DEFAULT_MEDIA=_struct(
        OTIO_SCHEMA=_S, name=_S, target_url=_S, available_range=_RANGE,
    )),
)
OTIO_DOC = _struct(
    OTIO_SCHEMA=_S, name=_S,
    tracks=_struct(OTIO_SCHEMA=_S, children=T.ArrayType(_struct(
        OTIO_SCHEMA=_S, kind=_S, children=T.ArrayType(OTIO_CHILD),
    ))),
)
