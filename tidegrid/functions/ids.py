"""Identity parsing: columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Video name aliases.
VIDEO_ALIASES = {
    "despicable_me_english": ["despicable_me_english", "dme", "DespMeEng"],
    "despicable_me_hungarian": ["despicable_me_hungarian"],
    "inscapes": ["inscapes"],
}

# How names spell their parts.
PATIENT = r"(?i)^((?:{prefixes})\d+(?:_\d+)?)"
RUN = r"(?i)run[-_]?(\d+)"
SESSION = r"(?i)ses[-_]?(\d+)"
FILE_TASK = r"task-([A-Za-z_0-9]+?)(?:_run-|_ieeg)"
FILE_SESSION = r"ses-([A-Za-z0-9]+)"
FILE_RUN = r"run-([0-9]+)"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    hit = F.regexp_extract(text, pattern, group)
    return F.when(hit != "", hit)


def _two_digits(text: Column) -> Column:
    number = text.cast("long").cast("string")
    return F.when(F.length(number) >= 2, number).otherwise(F.lpad(number, 2, "0"))


def patient_id(text: Column, prefixes: tuple[str, ...] = ("NS", "LH"), strict: bool = True) -> Column:
    """Leading subject code such as NS127_02, upper case. Strict: error if absent."""
    hit = _found(text, PATIENT.replace("{prefixes}", "|".join(prefixes)))
    if strict:
        hit = F.coalesce(hit, F.raise_error(F.concat(F.lit("no patient in: "), text)).cast("string"))
    return F.upper(hit)


def run_label(text: Column) -> Column:
    """run-NN; run-01 where the text names no run."""
    return F.concat(F.lit("run-"), F.coalesce(_two_digits(_found(text, RUN)), F.lit("01")))


def session_label(text: Column, patient: Column) -> Column:
    """Explicit ses-NN, else the numeric suffix of the patient, else ses-01."""
    number = F.coalesce(_found(text, SESSION), _found(patient, r"_(\d+)$"), F.lit("1"))
    return F.concat(F.lit("ses-"), _two_digits(number))


def entry_id(patient: Column, session: Column, run: Column) -> Column:
    return F.concat_ws("_", patient, session, run)


def parse_entry(entry: Column) -> Column:
    """struct(patient, session, run) of an entry key; absent parts are null."""
    return F.struct(
        F.regexp_replace(entry, r"(?i)(_ses-\d+)?(_run-\w+)?$", "").alias("patient"),
        F.lower(_found(entry, r"(?i)_(ses-\d+)(?:_run-\w+)?$")).alias("session"),
        F.lower(_found(entry, r"(?i)_(run-\w+)$")).alias("run"),
    )


def canonical(token: Column, aliases: dict[str, list[str]] = VIDEO_ALIASES) -> Column:
    """The name whose alias list holds the token, else null."""
    pairs = [F.lit(x) for name, known in aliases.items() for alias in known for x in (alias, name)]
    return F.try_element_at(F.create_map(*pairs), token)


def recording_name(name: Column, aliases: dict[str, list[str]] = VIDEO_ALIASES) -> Column:
    """struct(session, video, run) of a recording file name; video null where
    the task is unknown, session '' and run '01' where absent."""
    task = _found(name, FILE_TASK)
    return F.struct(
        F.coalesce(_found(name, FILE_SESSION), F.lit("")).alias("session"),
        canonical(task, aliases).alias("video"),
        F.coalesce(_two_digits(_found(name, FILE_RUN)), F.lit("01")).alias("run"),
    )


def electrode_group(label: Column) -> Column:
    """Label without its trailing contact number."""
    return F.regexp_replace(label, r"\d+$", "")


def contact_number(label: Column) -> Column:
    return _found(label, r"(\d+)$").cast("long")


def is_electrode(name: Column) -> Column:
    """L or R followed by letters and digits only."""
    return name.rlike(r"^[LR][A-Za-z0-9]+$")


def norm_label(label: Column) -> Column:
    return F.upper(F.trim(label))


def norm_hem(hem: Column) -> Column:
    """L or R from their common spellings, else ''."""
    h = F.upper(F.trim(hem))
    return F.when(h.isin("L", "LH", "LEFT"), "L").when(h.isin("R", "RH", "RIGHT"), "R").otherwise("")


def file_safe(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9_.-]+", "_")
