"""Path filters, file metadata and document ids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.common import let

# Default filters of a source scan, and the splitter of each file type.
IGNORED_DIR_REGEX = r"(_.*)|(data)|(venv)|(env)|(node_modules)"
IGNORED_FILE_REGEX = r".*lock.*"
SPLITTER_BY_EXTENSION = {".py": "python_ast", ".md": "markdown"}
DEFAULT_SPLITTER = "recursive"

# Line ends in the sense of a text editor: \r\n counts once.
_LINE_END = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]"


def relative_path(path: Column, root: Column | str) -> Column:
    """Path below ``root``: filters never look at the name of the root or of its parents."""
    root = F.lit(root) if isinstance(root, str) else root
    prefix = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(
        F.startswith(path, prefix), F.substring(path, F.length(prefix) + 1, F.length(path))
    ).otherwise(path)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_names(path: Column) -> Column:
    """Directory components of a path, without the file name."""
    return let(F.split(path, "/"), lambda p: F.slice(p, 1, F.size(p) - 1))


def prefix_matches(name: Column, regex: str) -> Column:
    """The regex matches at the start of ``name``; it need not reach its end."""
    return F.rlike(name, F.lit(f"^(?:{regex})"))


def in_hidden_dir(path: Column) -> Column:
    return F.exists(dir_names(path), lambda d: F.startswith(d, F.lit(".")))


def in_ignored_dir(path: Column, regex: str = IGNORED_DIR_REGEX) -> Column:
    return F.exists(dir_names(path), lambda d: prefix_matches(d, regex))


def is_ignored_file(path: Column, regex: str = IGNORED_FILE_REGEX) -> Column:
    return prefix_matches(base_name(path), regex)


def scan_filter(
    path: Column,
    ignored_dir_regex: str | None = IGNORED_DIR_REGEX,
    ignored_file_regex: str | None = IGNORED_FILE_REGEX,
    skip_hidden_dirs: bool = True,
) -> Column:
    """True for the files a scan keeps. ``path`` is relative to the scanned root."""
    keep = F.lit(True)
    if ignored_file_regex is not None:
        keep = keep & ~is_ignored_file(path, ignored_file_regex)
    if skip_hidden_dirs:
        keep = keep & ~in_hidden_dir(path)
    if ignored_dir_regex is not None:
        keep = keep & ~in_ignored_dir(path, ignored_dir_regex)
    return keep


def modified_since(last_modified: Column, since: Column) -> Column:
    """Inclusive; unknown times are dropped."""
    return F.coalesce(last_modified >= since, F.lit(False))


def extension(path: Column) -> Column:
    """Suffix with its dot; '' for names without one, for dot files and for a trailing dot."""
    return F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1)


def text_mode(content: Column) -> Column:
    """Content with every kind of line end turned into a line feed."""
    return F.replace(F.replace(content, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def size_bytes(content: Column) -> Column:
    return F.octet_length(content).cast("bigint")


def line_count(content: Column) -> Column:
    """Number of lines; a trailing line end does not start another one."""
    return let(
        F.split(content, _LINE_END),
        lambda lines: F.size(lines) - F.when(F.element_at(lines, -1) == "", 1).otherwise(0),
    ).cast("bigint")


def decodable(content: Column) -> Column:
    """Whether bytes are valid UTF-8."""
    return F.is_valid_utf8(content.cast("string"))


def iso_timestamp(ts: Column) -> Column:
    """ISO 8601 with microseconds only when there are any."""
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)),
    )


#: Characters that a quoted literal shows by their number: control, format, unassigned and private ones, and
#: every separator but the space.
_HIDDEN = r"[\p{C}\p{Zl}\p{Zp}\p{Zs}&&[^ ]]"


def _by_number(char: Column) -> Column:
    code = F.ascii(char)
    shown = F.lower(F.hex(code))
    return (
        F.when(code < 0x100, F.concat(F.lit("\\x"), F.lpad(shown, 2, "0")))
        .when(code < 0x10000, F.concat(F.lit("\\u"), F.lpad(shown, 4, "0")))
        .otherwise(F.concat(F.lit("\\U"), F.lpad(shown, 8, "0")))
    )


def quoted(text: Column) -> Column:
    """Text as a quoted literal: single quotes, or double ones if only single ones occur in it.

    Characters that can't be seen are shown by their number; which ones are unassigned depends on the version of
    Unicode that the JVM knows.
    """
    escaped = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for char, code in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(char), F.lit(code))
    # Few texts have others, and only those are taken apart.
    each = F.transform(F.split(escaped, ""), lambda c: F.when(c.rlike(_HIDDEN), _by_number(c)).otherwise(c))
    escaped = F.when(escaped.rlike(_HIDDEN), F.array_join(each, "")).otherwise(escaped)
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )


def require(value: Column, message: str) -> Column:
    """The value; the job fails with ``message`` when it is null."""
    return F.coalesce(value, F.raise_error(F.lit(message)).cast("string"))


def document_id(
    source: Column, last_modified_iso: Column, part: Column, num_parts: Column, size: Column
) -> Column:
    """Readable id of a chunk; a changed file gets new ids. All five fields are required."""

    def text(col: Column, name: str) -> Column:
        return require(col.cast("string"), f"document id: {name} is missing")

    return F.concat(
        F.lit("path="), quoted(text(source, "source")),
        F.lit(":last_modified="), quoted(text(last_modified_iso, "last_modified")),
        F.lit(":"), text(part, "part"), F.lit("/"), text(num_parts, "num_parts"),
        F.lit(":size="), text(size, "size"),
    )


def splitter_name(ext: Column) -> Column:
    """Name of the splitter for a file extension."""
    name = F.lit(DEFAULT_SPLITTER)
    for suffix, splitter in SPLITTER_BY_EXTENSION.items():
        name = F.when(ext == suffix, F.lit(splitter)).otherwise(name)
    return name


def merge_metadata(metadata: Column, extra: Column) -> Column:
    """Two map<string,string>; where a key is in both, the extra value wins."""
    kept = F.map_filter(metadata, lambda k, _v: ~F.array_contains(F.map_keys(extra), k))
    return F.map_concat(kept, extra)
