"""Scalar functions over text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Private-use characters that mark matches. Those of the text itself are replaced one for one, which keeps offsets.
_S, _E = "\ue000", "\ue001"
SPAN = "array<struct<start:int,end:int>>"
#: Parts of a text that are folded at once, and characters of a block of text.
CHUNK, SHIFT = 64, 12
BLOCK = 1 << SHIFT
#: A boundary of ASCII words: without (?U), \w is ASCII, but \b isn't in every version of Java.
_BOUNDARY = r"(?:(?=\w)(?<!\w)|(?!\w)(?<=\w))"
#: The letters beyond ASCII that fold to letters of it where case is ignored, in RE2: to s and k.
_LONG_S, _KELVIN = "\u017f", "\u212a"
#: With them, what RE2 takes for words where case is ignored (in classes; not at boundaries).
_WORD = f"0-9A-Za-z_{_LONG_S}{_KELVIN}"


def let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def java(pattern: str, ascii_words: bool = False) -> str:
    """A pattern for Java, whose classes and word boundaries follow Unicode. ascii_words: as RE2 reads it, in a text of `apart`."""
    if not ascii_words:
        return f"(?U){pattern}"
    if "(?i)" in pattern:
        pattern = pattern.replace(r"\W", f"[^{_WORD}]").replace(r"\w", f"[{_WORD}]")
    return "(?u)" + pattern.replace(r"\b", _BOUNDARY)


def apart(text: Column) -> Column:
    """A text, one character for one, without those that Java takes for letters, digits or white space and RE2 doesn't (a vertical tab among them)."""
    other = F.lit("\ufffd")
    lines = F.when(text.contains("\x0b"), F.replace(text, F.lit("\x0b"), other)).otherwise(text)
    return F.when(F.octet_length(text) == F.length(text), lines).otherwise(F.regexp_replace(lines, F.lit(rf"[\x80-\x{{10ffff}}&&[^{_LONG_S}{_KELVIN}]]"), other))


def folding(apart: Column) -> Column:
    """Whether a text of `apart` has letters beyond ASCII still."""
    return apart.contains(_LONG_S) | apart.contains(_KELVIN)


def spans(text: Column, pattern: str, maybe: Column | None = None, then=None, kind: str = SPAN, folds: Column | None = None) -> Column:
    """Code-point spans of the leftmost non-overlapping matches of a Java pattern, in order; empty for null.

    Texts without a match cost one search, or only maybe (a cheaper test that every match passes) where it is false. then: what is
    made of the spans (an array, of type kind), worked out for texts with a match alone. Classes and word boundaries follow Unicode.
    folds: they are of ASCII, as RE2 has it, in a text of `apart`; whether it is `folding`.
    """

    def read(made) -> Column:
        # Where only ASCII is left, Java's own boundary is the same, and several times faster.
        return made(java(pattern)) if folds is None else F.when(folds, made(java(pattern, True))).otherwise(made(f"(?u){pattern}"))

    plain = F.when(text.contains(_S) | text.contains(_E), F.translate(text, _S + _E, "\ufffd\ufffd")).otherwise(text)
    marked = read(lambda p: F.regexp_replace(plain, F.lit(f"(?:{p})"), F.lit(f"{_S}$0{_E}")))

    none = F.array().cast(SPAN)
    size = lambda part: F.length(part) - part.contains(_E).cast("int")

    def span(at: Column, part: Column) -> Column:
        return F.struct(at.alias("start"), (at + F.length(F.substring_index(part, _E, 1))).alias("end"))

    def step(state: Column, part: Column) -> Column:
        found = F.when(part.contains(_E), F.concat(state["found"], F.array(span(state["at"], part)))).otherwise(state["found"])
        return F.struct((state["at"] + size(part)).alias("at"), found.alias("found"))

    # Spans are gathered chunk by chunk, each from the length of what lies before it: a fold copies its state at every step.
    def gathered(chunks: Column) -> Column:
        begin = lambda at: F.struct(at.alias("at"), none.alias("found"))
        return let(
            running(F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda n, part: n + size(part)))),
            lambda before: F.flatten(F.transform(chunks, lambda c, i: F.aggregate(c, begin(F.get(before, i)), step, lambda s: s["found"]))),
        )

    # Most texts with a match have one.
    def found(parts: Column) -> Column:
        return F.when(F.size(parts) == 2, F.array(span(F.length(F.get(parts, F.lit(0))), F.get(parts, F.lit(1))))).otherwise(let(chunked(parts), gathered))

    hit = read(text.rlike) if maybe is None else maybe & read(text.rlike)
    made = let(F.split(marked, _S), found)
    return F.when(hit, made if then is None else then(made)).otherwise(F.array().cast(kind))


def chunked(values: Column) -> Column:
    """An array as an array of arrays of at most CHUNK."""
    return F.transform(F.sequence(F.lit(1), F.size(values), F.lit(CHUNK)), lambda c: F.slice(values, c, F.lit(CHUNK)))


def running(numbers: Column) -> Column:
    """For each number the sum of those before it, and at last the sum of all."""
    return F.aggregate(numbers, F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))


def blocks(text: Column) -> Column:
    """A text as an array of blocks of BLOCK characters, so that a piece of it is found without a walk from its beginning.

    Keep it in a column of its own: expressions over it are evaluated per piece.
    """
    several = F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{BLOCK}}})"), F.lit(1))
    return F.when(F.length(text).between(1, BLOCK), F.array(text)).otherwise(several)


def piece(block: Column, start: Column, end: Column) -> Column:
    """Characters start to end (exclusive) of a text given as blocks."""
    first, last = F.shiftright(start, SHIFT), F.shiftright(F.greatest(end - 1, start), SHIFT)
    part = F.when(first == last, F.get(block, first)).otherwise(F.concat(F.get(block, first), F.array_join(F.slice(block, first + 2, last - first), "")))
    return F.substr(part, start.bitwiseAND(F.lit(BLOCK - 1)) + 1, end - start)


def newlines(block: Column) -> Column:
    """Newlines before each block."""
    return running(F.transform(block, lambda b: F.length(b) - F.length(F.replace(b, F.lit("\n"), F.lit("")))))


def line_in(block: Column, before: Column, start: Column) -> Column:
    """1-based line of an offset, from a text's blocks and the newlines before each."""
    at = F.shiftright(start, SHIFT)
    part = F.left(F.coalesce(F.get(block, at), F.lit("")), start.bitwiseAND(F.lit(BLOCK - 1)))
    return F.get(before, at) + F.length(part) - F.length(F.replace(part, F.lit("\n"), F.lit(""))) + 1


def line_at(text: Column, start: Column) -> Column:
    """1-based line of an offset: newlines before it, plus one."""
    before = F.substr(text, F.lit(1), start)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def entropy(value: Column) -> Column:
    """Shannon entropy in bits per character; 0 for empty."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    total = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))
    return F.when(F.length(value) > 0, F.abs(total)).otherwise(F.lit(0.0))


def mask(value: Column) -> Column:
    """Masked for display: all of up to 8 characters, else all but the outer three on each side (at most 12 stars)."""
    v = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    stars = F.repeat(F.lit("*"), F.least(F.lit(12), F.length(v) - 6))
    return F.when(F.length(v) <= 8, F.repeat(F.lit("*"), F.length(v))).otherwise(F.concat(F.left(v, F.lit(3)), stars, F.right(v, F.lit(3))))


def n_tokens(text: Column) -> Column:
    """Words between white space; 0 for null."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda x: x != ""))


def fingerprint(text: Column) -> Column:
    return F.sha2(text, 256)


def clip(text: Column, limit: int = 500) -> Column:
    """At most limit characters, the last three of them dots if cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def utc_string(ts: Column) -> Column:
    """ISO 8601 in UTC with a Z, whatever the session's time zone; without a fraction where it is zero."""
    at = F.to_utc_timestamp(ts, F.current_timezone())
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.when(F.date_format(at, "SSSSSS") == "000000", whole).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))


def new_id(prefix: str) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12))


def numbered(prefix: str, n: Column, width: int = 3) -> Column:
    """prefix_001 and so on."""
    return F.format_string(f"{prefix}_%0{width}d", n)


def language(path: Column) -> Column:
    """Language of a source path by its suffix, or null."""
    p = F.lower(path)
    return (
        F.when(p.rlike(r"\.pyi?$"), "python").when(p.rlike(r"\.(jsx?|mjs|cjs)$"), "javascript").when(p.rlike(r"\.tsx?$"), "typescript")
    )


# The names of the ways in which network use is known, and of what was seen.
EGRESS_METHODS = ["engine-originated", "not-measured", "blocked-config", "measured-process", "os-isolation"]
EGRESS_SEEN = ["not-measured", "egress-observed", "no-egress-observed"]

#: A headline for each method, and what it does and doesn't tell.
EGRESS_LABELS = dict(zip(EGRESS_METHODS, [
    ("The engine opened no outside connection", "Seen from inside the engine alone: other programs, and the network itself, were not watched."),
    ("Network use unknown", "Another program ran, or was to run, and nothing watched what it sent."),
    ("Known ways out were closed by settings", "The settings were applied; whether the system enforces them was not tested."),
    ("The program's connections were sampled", "What opens and closes between two samples isn't seen: none seen is not none made."),
    ("The system kept the program off the network", "The boundary was in force, and was tested."),
]))


def egress_label(method: Column) -> tuple[Column, Column]:
    """(label, details) of an egress method."""
    label, details = F.lit("No word on network use"), F.lit("The session's log holds no observation of it.")
    for name, (a, b) in EGRESS_LABELS.items():
        label, details = F.when(method == name, a).otherwise(label), F.when(method == name, b).otherwise(details)
    return label, details


def egress_seen(connections: Column, measured: Column) -> tuple[Column, Column, Column]:
    """(observed, word, method) of a process whose new connections were sampled, or whose sampling wasn't available."""
    some = F.coalesce(F.size(connections) > 0, F.lit(False))
    unknown, seen, none = map(F.lit, EGRESS_SEEN)
    on = F.coalesce(measured, F.lit(False))
    return some, F.when(~on, unknown).when(some, seen).otherwise(none), F.when(on, "measured-process").otherwise("not-measured")


def endpoints(connections: Column, limit: int = 5) -> Column:
    """'ip:port' of the first few connections, with '(+N more)'; 'none observed' if there are none."""
    shown = F.array_join(F.transform(F.slice(connections, 1, limit), lambda c: F.concat_ws(":", c["remote_ip"], c["remote_port"].cast("string"))), ", ")
    more = F.when(F.size(connections) > limit, F.format_string(" (+%d more)", F.size(connections) - limit)).otherwise("")
    return F.when(F.size(connections) > 0, F.concat(shown, more)).otherwise("none observed")
