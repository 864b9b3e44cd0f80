"""Object paths, file names and content types."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gradeflow.functions.text import as_col

# Extensions taken up by a folder scan (any case).
SCAN_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".tiff")
# Extensions accepted for an upload (all lower or all upper case).
UPLOAD_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".JPG", ".JPEG", ".PNG", ".GIF", ".WEBP")
UPLOAD_TYPES = ("image/jpeg", "image/png", "image/gif", "image/webp")
# Content type by extension, default and variants.
MIME_TYPES = {
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
    ".gif": "image/gif",
    ".webp": "image/webp",
}
MIME_VARIANTS = {
    "model": (MIME_TYPES, "image/jpeg"),
    "labelling": ({**MIME_TYPES, ".bmp": "image/bmp"}, "image/jpeg"),
    "serve": (MIME_TYPES, "application/octet-stream"),
}
MAX_FILENAME = 200
MAX_UPLOAD_BYTES = 10 * 1024 * 1024
SCHEME = "gs://"


def basename(path: Column | str) -> Column:
    return F.substring_index(as_col(path), "/", -1)


def extension(path: Column | str) -> Column:
    """From the last dot of the file name on, or "" where there is none."""
    name = basename(path)
    return F.when(name.contains("."), F.concat(F.lit("."), F.substring_index(name, ".", -1))).otherwise("")


def splitext(path: Column | str) -> Column:
    """Extension as a file system sees it: a leading dot starts no extension."""
    return F.regexp_extract(basename(path), r"^\.*[^.].*(\.[^.]*)$", 1)


def parse_object_path(path: Column | str) -> Column:
    """``gs://bucket/prefix`` to (bucket, prefix, error)."""
    path = as_col(path)
    rest = F.substr(path, F.lit(len(SCHEME) + 1))
    slash = F.instr(rest, "/")
    bucket = F.when(slash > 0, F.substr(rest, F.lit(1), slash - 1)).otherwise(rest)
    prefix = F.when(slash > 0, F.ltrim(F.substr(rest, slash + 1), F.lit("/"))).otherwise("")
    error = F.when(
        ~path.startswith(SCHEME), F.concat(F.lit(f"GCS path must start with {SCHEME}. Got: "), path)
    ).when(
        bucket == "", F.concat(F.lit("Invalid GCS path: "), path, F.lit(". Bucket name is required."))
    )
    good = error.isNull()
    return F.struct(
        F.when(good, bucket).alias("bucket"), F.when(good, prefix).alias("prefix"), error.alias("error")
    )


def mime_type(path: Column | str, variant: str = "model") -> Column:
    """Content type by extension; the variants differ in bmp and in the default."""
    table, default = MIME_VARIANTS[variant]
    ext = F.lower(extension(path))
    result = F.lit(default)
    for name, mime in table.items():
        result = F.when(ext == name, F.lit(mime)).otherwise(result)
    return result


def is_scannable(path: Column | str, extensions: tuple[str, ...] = SCAN_EXTENSIONS) -> Column:
    return F.lower(extension(path)).isin(*extensions)


def is_uploadable(filename: Column | str, content_type: Column | str) -> Column:
    """Known content type, or a known extension in all-lower or all-upper case."""
    known = F.coalesce(as_col(content_type).isin(*UPLOAD_TYPES), F.lit(False))
    return known | splitext(filename).isin(*UPLOAD_EXTENSIONS)


def upload_error(filename: Column | str, content_type: Column | str) -> Column:
    """Why a file is refused, or NULL."""
    ext = splitext(filename)
    allowed = "(allowed: .jpg, .jpeg, .png, .gif, .webp)"
    return F.when(
        ~is_uploadable(filename, content_type),
        F.when(ext != "", F.concat(F.lit("Invalid file extension '"), ext, F.lit(f"' {allowed}"))).otherwise(
            F.lit(f"No file extension {allowed}")
        ),
    )


def sanitize_filename(name: Column | str) -> Column:
    """Replace everything but word characters, white space, '-' and '.', keep 200 characters."""
    return F.substring(F.regexp_replace(as_col(name), r"(?U)[^\w\s\-.]", "_"), 1, MAX_FILENAME)


def clash_name(filename: Column | str, full_path: Column | str) -> Column:
    """Name for a file whose name is taken: 8 hex digits of its path before the extension."""
    filename = as_col(filename)
    mark = F.substring(F.md5(as_col(full_path)), 1, 8)
    dotted = filename.contains(".")
    ext = F.when(dotted, F.substring_index(filename, ".", -1)).otherwise("")
    base = F.when(
        dotted, F.substr(filename, F.lit(1), F.char_length(filename) - F.char_length(ext) - 1)
    ).otherwise(filename)
    return F.concat(base, F.lit("_"), mark, F.lit("."), ext)


def destination_path(project_id: Column | str, dataset_id: Column | str, filename: Column | str) -> Column:
    return F.concat(
        F.lit("projects/"), as_col(project_id), F.lit("/datasets/"), as_col(dataset_id), F.lit("/"), as_col(filename)
    )
