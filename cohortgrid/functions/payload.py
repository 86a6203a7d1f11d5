"""Recording-payload manifest: format from leading bytes, validity, file name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_PAYLOAD_BYTES = 1000


def _head(payload: Column, n: int) -> Column:
    return F.hex(F.substring(payload, 1, n))


def _hex(text: str) -> str:
    return text.encode("latin-1").hex().upper()


def _contains(payload: Column, n: int, *marks: str) -> Column:
    """Whether any mark occurs byte-aligned within the first ``n`` bytes."""
    pattern = "^(..)*?(" + "|".join(_hex(m) for m in marks) + ")"
    return _head(payload, n).rlike(pattern)


def _starts(payload: Column, *marks: str) -> Column:
    return _head(payload, 8).rlike("^(" + "|".join(_hex(m) for m in marks) + ")")


def _adts(payload: Column) -> Column:
    return _head(payload, 2).rlike("^FFF")


def detect_format(payload: Column) -> Column:
    """Container name; the first matching signature decides."""
    too_short = payload.isNull() | (F.octet_length(payload) < 10)
    return (
        F.when(too_short, "unknown")
        .when(_contains(payload, 20, "ftyp3gp"), "3gp")
        .when(_contains(payload, 12, "ftyp") & _contains(payload, 20, "M4A ", "M4B ", "mp42", "isom"), "m4a")
        .when(_starts(payload, "caff"), "caf")
        .when(_adts(payload), "aac")
        .when(_starts(payload, "RIFF") & _contains(payload, 20, "WAVE"), "wav")
        .when(_starts(payload, "ID3", "\xff\xfb"), "mp3")
        .when(_starts(payload, "#!AMR"), "amr")
        .otherwise("unknown")
    )


def validate(payload: Column, fmt: Column) -> dict[str, Column]:
    """``is_valid`` and ``reason`` for a payload of the given format."""
    size = F.octet_length(payload)
    m4a_marks = _contains(payload, 50, "M4A ", "mp42", "isom") | _contains(payload, 100, "mdat")
    problem = (
        F.when(payload.isNull() | (size == 0), "No audio data")
        .when(size < MIN_PAYLOAD_BYTES, F.format_string("Audio data too small (%d bytes)", size))
        .when((fmt == "3gp") & ~_contains(payload, 20, "ftyp3gp"), "Invalid 3GP signature")
        .when((fmt == "m4a") & ~_contains(payload, 12, "ftyp"), "Invalid M4A signature")
        .when((fmt == "m4a") & ~m4a_marks, "Missing M4A audio markers")
        .when((fmt == "caf") & ~_starts(payload, "caff"), "Invalid CAF signature")
        .when((fmt == "aac") & ~_adts(payload), "Invalid AAC ADTS header")
        .when((fmt == "wav") & ~_starts(payload, "RIFF"), "Invalid WAV signature")
        .when((fmt == "wav") & ~_contains(payload, 20, "WAVE"), "Missing WAVE header")
        .when((fmt == "mp3") & ~_starts(payload, "ID3", "\xff\xfb"), "Invalid MP3 signature")
    )
    good = F.concat(F.lit("Valid "), F.upper(fmt), F.lit(" file ("), F.format_number(size, 0), F.lit(" bytes)"))
    return {"is_valid": problem.isNull(), "reason": F.coalesce(problem, good)}


def descriptive_name(audio_id: Column, survey: Column, question: Column, ts: Column, created: Column,
                     fmt: Column) -> Column:
    def part(value: Column, fallback: str) -> Column:
        return F.coalesce(value.cast("string"), F.lit(fallback))

    stamp = F.date_format(F.coalesce(ts, created), "yyyyMMdd_HHmmss")
    extension = F.when(fmt == "unknown", "bin").otherwise(fmt)
    return F.concat(
        F.lit("db_audio_"), part(audio_id, "unknown"),
        F.lit("_survey_"), part(survey, "unknown"),
        F.lit("_q_"), part(question, "unknown"),
        F.lit("_"), part(stamp, "unknown_time"),
        F.lit("."), extension,
    )
