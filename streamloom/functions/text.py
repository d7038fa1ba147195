"""Text functions as Column expressions: everything stays in the JVM, nothing is a UDF.

Python's \\w, \\b and \\s know Unicode, Java's do so under (?U); (?d) lets only a line feed end a line.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V

ID = "(?U)\\b([PO])([0-9]+)\\b"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, f) -> Column:
    """f(value), with value computed once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def rounded(c: Column | str, digits: int) -> Column:
    """The nearest number of so many digits as SQL engines on doubles take it: the product with a power of ten, halves away from zero.

    F.round rounds the shortest decimal that names a double, so 0.12345 goes up even where the double lies below the half.
    """
    c, unit = _col(c), F.lit(10.0**digits)
    near = F.round(c * unit) / unit
    return F.when(near == 0, c * 0.0).otherwise(near)  # the sign of zero is kept


def plain(c: Column | str, digits: int) -> Column:
    """A number of so many digits as text, never with an exponent."""
    c = _col(c)
    return F.when(c.isNotNull(), F.regexp_replace(F.format_string(f"%.{digits}f", c), "(\\.[0-9]+?)0+$", "$1"))


def normalise(c: Column | str) -> Column:
    """Lower case, ends trimmed, white space to single spaces."""
    return F.trim(F.regexp_replace(F.lower(_col(c)), "(?U)\\s+", " "))


def accepted(c: Column | str) -> Column:
    """Whether an item of a caption is kept: five characters or more, and none of the words for nothing."""
    c = F.trim(_col(c))
    return (F.char_length(c) >= 5) & ~F.upper(c).isin("NONE", "N/A", "-")


def stable_id(c: Column | str) -> Column:
    """A leading P or O with a number; null if there is none."""
    return F.nullif(F.regexp_extract(_col(c), "(?U)^([PO][0-9]+)\\b", 1), F.lit(""))


def referenced_ids(c: Column | str) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(ID), F.lit(0))


def id_text(c: Column | str) -> Column:
    """What stands before the first colon."""
    return F.trim(F.substring_index(_col(c), ":", 1))


def dedup_key(text: Column | str, kind: Column | str, typed: bool = True) -> Column:
    """id:<id> for entities with an id, else the normalised text, with the node type in front if typed."""
    text, kind = _col(text), _col(kind)
    plain = F.concat_ws(":", kind, normalise(text)) if typed else normalise(text)
    return F.when((kind == "entity") & stable_id(text).isNotNull(), F.concat(F.lit("id:"), stable_id(text))).otherwise(plain)


def entity_description(c: Column | str) -> Column:
    """The identity in an entity item: no id, what is in leading brackets or before a colon, local ids as nouns."""
    bare = F.trim(F.regexp_replace(_col(c), "(?U)^[PO][0-9]+\\b\\s*:?\\s*", ""))
    inner = F.when(bare.startswith("(") & bare.contains(")"), F.regexp_extract(bare, "(?s)^\\(([^)]*)\\)", 1)).otherwise(F.substring_index(bare, ":", 1))
    named = F.regexp_replace(F.regexp_replace(inner, "(?U)\\bP[0-9]+\\b", "person"), "(?U)\\bO[0-9]+\\b", "object")
    return F.regexp_replace(F.regexp_replace(named, "(?U)\\s+", " "), "^[ ()]+|[ ()]+$", "")


def stem(c: Column | str) -> Column:
    """A crude English stem: a suffix goes, a doubled last consonant is halved, or a silent e comes back."""

    def cut_off(w: Column, suffix: Column) -> Column:
        def restored(cut: Column) -> Column:
            doubled = suffix.isin("ing", "ings", "ed", "ied") & (F.char_length(cut) >= 3) & cut.rlike("([^aeiou])\\1$")
            silent = suffix.isin("ing", "ings", "ed", "es") & (F.char_length(cut) == 3) & cut.rlike("^[^aeiou][aeiou][^aeiouwxy]$")
            return F.when((suffix == "") | (cut == ""), w).when(doubled, F.substr(cut, F.lit(1), F.char_length(cut) - 1)).when(silent, F.concat(cut, F.lit("e"))).otherwise(cut)

        return let(F.substr(w, F.lit(1), F.char_length(w) - F.char_length(suffix)), restored)

    return let(F.lower(_col(c)), lambda w: let(F.regexp_extract(w, "(ings?|ied|ed|es|s)$", 1), lambda suffix: cut_off(w, suffix)))


def keywords(c: Column | str) -> Column:
    """Distinct stems of the words of four letters and more, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.lower(_col(c)), F.lit("(?U)\\b\\w{4,}\\b"), F.lit(0)), stem)))


def stem_of(word: str) -> str:
    """The stem of a fixed word, as `stem` has it: Spark would stem a list of fixed words anew for each row."""
    word = word.lower()
    suffix = re.search("(ings?|ied|ed|es|s|)$", word)[1]
    cut = word.removesuffix(suffix)
    if not suffix or not cut:
        return word
    if suffix in ("ing", "ings", "ed", "ied") and len(cut) >= 3 and re.search("([^aeiou])\\1$", cut):
        return cut[:-1]
    return cut + "e" if suffix in ("ing", "ings", "ed", "es") and re.search("^[^aeiou][aeiou][^aeiouwxy]$", cut) else cut


def temporal_stems() -> Column:
    return F.array(*map(F.lit, dict.fromkeys(map(stem_of, V.TEMPORAL_WORDS))))


def stop_stems() -> Column:
    return F.array(*map(F.lit, dict.fromkeys(map(stem_of, V.COUNT_STOP_WORDS))))


def content_stems(c: Column | str) -> Column:
    return F.array_except(F.filter(keywords(c), lambda s: F.char_length(s) >= 3), stop_stems())


def has_any(c: Column | str, phrases: tuple[str, ...]) -> Column:
    low = F.lower(_col(c))
    return reduce(lambda a, b: a | b, [low.contains(p) for p in phrases])


def is_count_question(c: Column | str) -> Column:
    return has_any(c, V.COUNT_PHRASES)


def count_focus(c: Column | str) -> Column:
    """The activity that a counting question asks for; the question itself if it names none."""
    q = _col(c)
    after = F.regexp_replace(q, "(?is)^.*answer the following question:", "")
    found = F.regexp_extract_all(after, F.lit("(?iU)how many times\\s+(?:do(?:es)?|did|has|have|are|is|will)?\\s*(?:they|he|she|the\\s+\\S+|people|someone)?\\s*([^?.\\n]+)"), F.lit(1))
    focus = F.regexp_replace(F.trim(F.element_at(found, -1)), "[?. ]+$", "")
    for _ in range(4):
        focus = F.regexp_replace(focus, "(?i)^(?:in total|in all|in the video|total(?:ly)?|so far|now|have|has|had|been|did|do|does|are|is|was|were)\\s+", "")
    focus = F.regexp_replace(F.trim(F.regexp_replace(focus, "(?i)\\s+(?:so far|in total|up to now|to date|in the video|by now)\\b.*$", "")), "[?. ]+$", "")
    return F.when(F.size(found) > 0, F.coalesce(F.nullif(focus, F.lit("")), q)).otherwise(q)


def strip_subject(text: Column | str, hub: Column | str) -> Column:
    """The text without the hub's words in front and without an auxiliary verb after them; the text itself if hardly anything is left."""
    text, hub = _col(text), F.lower(F.trim(_col(hub)))
    rest = F.regexp_replace(F.ltrim(F.substr(text, F.char_length(hub) + 1)), "(?i)^(is|are|was|were|has|have)\\s+", "")
    return F.when(F.lower(F.trim(text)).startswith(hub), let(rest, lambda r: F.when(F.char_length(r) > 3, r).otherwise(text))).otherwise(text)


def minutes(seconds: Column | str) -> Column:
    """MM:SS, with as many minutes as there are."""
    s = F.floor(F.greatest(_col(seconds), F.lit(0.0))).cast("long")
    return F.format_string("%02d:%02d", F.floor(s / 60).cast("long"), s % 60)


def hours(seconds: Column | str) -> Column:
    """HH:MM:SS from one hour on, else MM:SS."""
    s = F.floor(F.greatest(_col(seconds), F.lit(0.0))).cast("long")
    h = F.floor(s / 3600).cast("long")
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, F.floor(s % 3600 / 60).cast("long"), s % 60)).otherwise(minutes(s))


def timestamp_to_seconds(c: Column | str) -> Column:
    """H:M:S, M:S or S; if a part is no number, the numbers found in the text; nothing is 0."""
    text = F.trim(_col(c))
    parts = F.filter(F.split(text, ":"), lambda p: p != "")
    numbers = F.transform(parts, lambda p: p.try_cast("double"))
    numbers = F.when(F.exists(numbers, lambda n: n.isNull()), F.transform(F.regexp_extract_all(text, F.lit("[0-9]+(?:\\.[0-9]+)?"), F.lit(0)), lambda p: p.try_cast("double"))).otherwise(numbers)
    n = F.size(numbers)
    at = lambda k: F.get(numbers, n - k)
    return F.when(F.size(parts) == 0, 0.0).when(n >= 3, at(3) * 3600 + at(2) * 60 + at(1)).when(n == 2, at(2) * 60 + at(1)).otherwise(at(1))


def question_key(c: Column | str) -> Column:
    return F.regexp_replace(normalise(c), "(?U)[^\\w\\s]+", "")


def format_options(c: Column | str) -> Column:
    """Options a line each, lettered unless they are."""
    return F.array_join(F.transform(_col(c), lambda o, i: F.when(F.trim(o).rlike("^[A-Z]\\s*[.)]"), F.trim(o)).otherwise(F.concat(F.char(i + 65), F.lit(". "), F.trim(o)))), "\n")


def mcq_letter(c: Column | str, last: str = "F") -> Column:
    """The first lone letter up to last, else a lone digit as a letter; null for neither."""
    up = F.upper(F.trim(_col(c)))
    n = ord(last) - 64
    digit = F.regexp_extract(up, f"(?U)\\b([1-{n}])\\b", 1).try_cast("int")
    return F.coalesce(F.nullif(F.regexp_extract(up, f"(?U)\\b([A-{last}])\\b", 1), F.lit("")), F.char(digit + 64))


def clamp_count(c: Column | str, cap: int = 0) -> Column:
    """The first number in a response, at least 0 and at most cap (0: no cap)."""
    n = F.regexp_extract(_col(c), "([0-9]+)", 1).try_cast("int")
    return F.when(n.isNotNull(), F.least(F.greatest(n, F.lit(0)), F.lit(cap)) if cap else F.greatest(n, F.lit(0)))


def yes_no(c: Column | str, default: str | None = None) -> Column:
    """A lone A means yes, a lone B no; else YES or Y, then NO or N; the default (null) for anything else."""
    up = F.upper(F.trim(_col(c)))
    said = F.when(up.rlike("(?U)\\bA\\b"), "Yes").when(up.rlike("(?U)\\bB\\b"), "No").when(up.contains("YES") | (up == "Y"), "Yes").when(up.contains("NO") | (up == "N"), "No")
    return F.coalesce(said, F.lit(default).cast("string"))


def prompt(template: str, **values: Column) -> Column:
    """The template with each {name} replaced by a column; braces of unknown names stay."""
    out, parts = [], re.split(r"\{(\w+)\}", template)
    for i, p in enumerate(parts):
        if i % 2 == 0:
            out.append(F.lit(p))
        else:
            out.append(F.coalesce(values[p].cast("string"), F.lit("")) if p in values else F.lit("{" + p + "}"))
    return F.concat(*out)


def mcq_prompt(question: Column, options: Column, template: str = V.CHOICE_TEMPLATE) -> Column:
    """A question of choice; null without a question or two to six options, none of them blank."""
    n = F.size(options)
    good = (F.trim(question) != "") & n.between(2, 6) & F.forall(options, lambda o: F.coalesce(F.trim(o) != "", F.lit(False)))
    return F.when(good, prompt(template, question=question, options=format_options(options)))


def delta_options(max_delta: int) -> str:
    """The options of an interval count: so many new instances up to max_delta, and unclear."""
    return "\n".join([f"{chr(65 + i)}. {i} new" for i in range(max_delta + 1)] + [f"{chr(66 + max_delta)}. unclear, count 0 new"])


def activity_prompt(base: str, activity: Column) -> Column:
    """A caption prompt with the rule that a counted activity is named only where its decisive moment is seen."""
    a = F.lower(F.trim(F.regexp_replace(F.trim(activity), "^[.?! ]+|[.?! ]+$", "")))
    return prompt(base + V.ACTIVITY_TEMPLATE, activity=a)


def truth_letter(answer: Column) -> Column:
    """The letter of the right answer, or the answer itself in capitals."""
    return F.coalesce(mcq_letter(answer, "D"), F.upper(F.trim(answer)))


def chosen(logits: Column) -> Column:
    """The letter of the largest logit, the first of equals."""
    return F.char(F.array_position(logits, F.array_max(logits)).cast("int") + 64)


def option_value(c: Column | str) -> Column:
    """The number an option names, in digits or words."""
    text = F.trim(F.regexp_replace(F.trim(_col(c)), "(?i)^[A-Z]\\s*[.)]\\s*", ""))
    digits = F.regexp_extract(text, "([0-9]+)", 1).try_cast("int")
    low = F.lower(text)
    named = F.coalesce(*[F.when(low.rlike(f"(?U)\\b{w}\\b"), F.lit(v)) for w, v in V.NUMBER_WORDS.items()])
    return F.coalesce(digits, named)


def count_to_option(count: Column | str, options: Column | str) -> Column:
    """The letter of the option nearest to a count, the first of equals; A if no option has a number."""
    count = _col(count)
    pairs = F.filter(F.transform(_col(options), lambda o, i: F.struct(F.abs(option_value(o) - count).alias("d"), i.alias("i"))), lambda p: p["d"].isNotNull())
    return F.coalesce(F.char(F.get(F.array_sort(pairs), F.lit(0))["i"] + 65), F.lit("A"))


def resolve_path(c: Column | str, folder: str, exists: Column | None = None) -> Column:
    """Where a video lies: ./videos/x.mp4 in the folder if it is there, else x/video.mp4; other relative paths below the folder."""
    p = _col(c)
    base = F.regexp_extract(p, "([^/]*)$", 1)
    plain = F.concat(F.lit(folder + "/"), base)
    name = F.regexp_replace(F.regexp_replace(base, "\\.[^.]*$", ""), "_real$", "")
    return F.when(p.startswith("./videos/"), F.when(F.coalesce(exists, F.lit(False)) if exists is not None else F.lit(False), plain).otherwise(F.concat(F.lit(folder + "/"), name, F.lit("/video.mp4")))).when(p.startswith("/"), p).otherwise(F.concat(F.lit(folder + "/"), p))


def row_key(video: Column, ts: Column, task: Column, question: Column, occurrence: Column | None = None) -> Column:
    legacy = F.concat_ws("_", video, F.coalesce(ts, F.lit("")), F.coalesce(task, F.lit("")), F.substring(F.coalesce(question, F.lit("")), 1, 80))
    return legacy if occurrence is None else F.when(occurrence.isNotNull(), F.concat(F.lit("annotation:"), occurrence)).otherwise(legacy)


def uniform_indices(n: Column | str, k: Column | str) -> Column:
    """k places spread evenly over 0..n-1, rounded half to even; all of them if k >= n, the last for k = 1."""
    n, k = _col(n).cast("int"), _col(k).cast("int")
    spread = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), lambda i: F.rint(i * (n - 1) / F.greatest(k - 1, F.lit(1))).cast("int")))
    return F.when((k <= 0) | (n <= 0), F.array().cast("array<int>")).when(n <= k, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).when(k == 1, F.array(n - 1)).otherwise(spread)
