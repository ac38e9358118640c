"""Names, paths, codes and labels as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glimset.schemas import FAILED, NO_FACE, PENDING, PROCESSED, PROCESSING


def file_extension(name: Column) -> Column:
    """From the last dot on, in its own case; ``.jpg`` without a dot or name."""
    return F.when(F.instr(name, ".") > 0, F.concat(F.lit("."), F.substring_index(name, ".", -1))).otherwise(".jpg")


def stored_path(batch_id: Column, file_id: Column, name: Column) -> Column:
    return F.concat(batch_id, F.lit("/"), file_id, file_extension(name))


def image_url(path: Column) -> Column:
    return F.concat(F.lit("/images/"), path)


def absolute_path(path: Column, root: str = "/var/uploads/") -> Column:
    return F.concat(F.lit(root), path)


def search_scope(token: Column) -> Column:
    """The temporary folder of a search."""
    return F.concat(F.lit("temp_search_"), F.substring(token, 1, 8))


def access_code(token: Column) -> Column:
    """Six upper-case characters from a token that is drawn once a request."""
    return F.upper(F.substring(token, 1, 6))


def derived_access_code(batch_id: Column) -> Column:
    """An access code that follows from the batch."""
    return access_code(F.md5(batch_id))


def normalized_access_code(code: Column) -> Column:
    return F.upper(F.trim(code))


def classified_error(message: Column) -> Column:
    """The state that an extractor's error leads to; case-sensitive."""
    return F.when(message.contains("No face detected"), NO_FACE).otherwise(FAILED)


def escaped_quotes(text: Column) -> Column:
    return F.replace(text, F.lit("'"), F.lit("''"))


def trimmed_end(text: Column) -> Column:
    """Without line ends and spaces at the end; tabs stay."""
    return F.regexp_replace(text, r"[\n\r ]+\z", "")


def error_payload(body: Column) -> Column:
    """The message of a body that starts with ``ERROR:``, else null."""
    return F.when(body.startswith("ERROR:"), F.trim(F.substring(body, 7, 1 << 30)))


def bearer_token(header: Column) -> Column:
    return F.when(header.startswith("Bearer "), F.substring(header, 8, 1 << 30))


def plural(n: Column) -> Column:
    return F.when(n != 1, "s").otherwise("")


def counted(n: Column, noun: str) -> Column:
    """``1 photo``, ``2 photos``."""
    return F.concat(n.cast("string"), F.lit(f" {noun}"), plural(n))


def shown_time(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd HH:mm:ss")


def status_label(status: Column, photos: Column, processed: Column, no_face: Column) -> Column:
    """What a dashboard says about a batch; null counts are 0."""
    n, done, none = (F.coalesce(c, F.lit(0)) for c in (photos, processed, no_face))
    said = F.concat_ws(
        ", ",
        F.when(done > 0, F.concat(done.cast("string"), F.lit(" faces found"))),
        F.when(none > 0, F.concat(none.cast("string"), F.lit(" skipped (no face)"))),
        F.when(n - done - none > 0, F.lit("some failed")),
    )
    finished = F.when(said == "", "Finished").otherwise(said)
    running = F.concat((done + none).cast("string"), F.lit(" / "), n.cast("string"), F.lit(" processed"))
    return F.when(status.isin(PROCESSED, "NO_FACES_FOUND"), finished).when(status == FAILED, "Failed (System Error)").otherwise(running)


def status_icon(status: Column) -> Column:
    """The kind of icon for a batch's state."""
    return F.when(status == PROCESSED, "done").when(status == FAILED, "error").when(status.isin(NO_FACE, "NO_FACES_FOUND"), "warning").when(status.isin(PENDING, PROCESSING), "running").otherwise("running")
