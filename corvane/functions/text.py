"""Text functions over Columns.

Word and blank classes are spelled out (``\\p{L}``, ``\\p{N}``), because Java's
and other engines' defaults differ on text outside ASCII.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: English words that a retrieval index leaves out.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by "
    "can did do does doing down during each few for from further had has have having he her here hers herself him himself his how "
    "i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own "
    "s same she should so some such t than that the their theirs them themselves then there these they this those through to too "
    "under until up very was we were what when where which while who whom why will with you your yours yourself yourselves"
).split()


def squeeze(text: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def html_to_text(source: Column) -> Column:
    """Line and paragraph ends to newlines, other tags to spaces, then white space squeezed (newlines included)."""
    steps = ((r"(?i)<br\s*/?>", "\n"), (r"(?i)</p>", "\n\n"), (r"<[^>]+>", " "))
    return squeeze(reduce(lambda c, step: F.regexp_replace(c, *step), steps, source))


def visible_text(source: Column) -> Column:
    """``html_to_text`` without the bodies of scripts and styles."""
    return html_to_text(F.regexp_replace(F.regexp_replace(source, r"(?is)<script[^>]*>.*?</script>", " "), r"(?is)<style[^>]*>.*?</style>", " "))


def retrieval_terms(text: Column, stop_words: tuple[str, ...] | list[str] = STOP_WORDS) -> Column:
    """Lower-case words without punctuation and stop words, as an array."""
    words = F.split(squeeze(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", "")), " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*stop_words))


def email_addresses(text: Column) -> Column:
    """All addresses in a text, in order."""
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0))


def tagged_answer(text: Column, tag: str = "answer") -> Column:
    """What stands in the first <tag>...</tag>, in either case and over lines; else the whole text. Trimmed."""
    found = F.regexp_extract(text, rf"(?is)<{tag}>(.*?)</{tag}>", 1)
    return F.trim(F.when(text.rlike(rf"(?is)<{tag}>.*?</{tag}>"), found).otherwise(text))


def tool_calls(text: Column) -> Column:
    """The JSON bodies of <tool_call> blocks, the last one maybe unterminated; bodies that aren't JSON are dropped."""
    bodies = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>(.*?)(?:</tool_call>|\z)"), F.lit(1)), lambda b: F.trim(b))
    return F.filter(bodies, lambda b: F.try_parse_json(b).isNotNull() & b.startswith("{"))


def module_of_path(path: Column) -> Column:
    """``a/b.py`` to ``a.b``."""
    return F.replace(F.regexp_replace(path, r"\.py$", ""), F.lit("/"), F.lit("."))


def path_of_module(module: Column) -> Column:
    """``a.b`` to ``a/b.py``."""
    return F.concat(F.replace(module, F.lit("."), F.lit("/")), F.lit(".py"))


def short_model_name(name: Column) -> Column:
    """Last path part in lower case, without ``-instruct``."""
    return F.regexp_replace(F.element_at(F.split(F.lower(name), "/"), -1), "-instruct$", "")


def strip_latex_comments(text: Column) -> Column:
    """Cuts each line at its first unescaped percent sign, trims its end, and drops blank lines."""
    lines = F.transform(F.split(text, "\n"), lambda line: F.rtrim(F.regexp_replace(line, r"(?<!\\)%.*$", "")))
    return F.array_join(F.filter(lines, lambda line: F.trim(line) != ""), "\n")


def drop_thinking(text: Column) -> Column:
    """Text without its first <think>...</think> span."""
    return F.regexp_replace(text, r"(?s)^(.*?)<think>.*?</think>", "$1")


def after_thinking(text: Column, end: str = "<|eot|>") -> Column:
    """What follows the last </think>, without a special ending."""
    plain = F.when(text.endswith(end), F.left(text, F.length(text) - len(end))).otherwise(text)
    return F.element_at(F.split(plain, "</think>"), -1)


def list_answers(text: Column) -> Column:
    """What follows the last colon, without brackets, quotes, blanks and dots at its ends, split at commas and trimmed."""
    tail = F.element_at(F.split(text, ":"), -1)
    return F.transform(F.split(F.btrim(tail, F.lit("{}'\" .,\t\n")), ","), lambda x: F.trim(x))


def ends_with_answer(prediction: Column, answer: Column) -> Column:
    """Whether a prediction ends with the answer, case and outer blanks aside."""
    return F.endswith(F.lower(F.trim(prediction)), F.lower(F.trim(answer)))


def frame_file(path: Column, content: Column) -> Column:
    """``File: path`` and the content, Python in a fence."""
    python = F.concat(F.lit("File: "), path, F.lit("\n```python\n"), content, F.lit("\n```"))
    return F.when(path.endswith(".py"), python).otherwise(F.concat(F.lit("File: "), path, F.lit("\n"), content))


def section_between(text: Column, start: str, end: str) -> Column:
    """From the first start marker to the end of the next end marker; '' if either is missing."""
    at = F.locate(start, text)
    rest = F.substring(text, at, F.length(text))
    stop = F.locate(end, rest)
    return F.when((at > 0) & (stop > 0), F.left(rest, stop + len(end) - 1)).otherwise("")


def capitalize(text: Column) -> Column:
    """First letter upper, the rest lower, separators to spaces."""
    return F.concat(F.upper(F.left(text, F.lit(1))), F.translate(F.lower(F.substring(text, F.lit(2), F.length(text))), "_-", "  "))


def choice_prompt(question: Column, options: Column) -> Column:
    """A question, its lettered options and where to put the answer."""
    lettered = F.transform(options, lambda o, i: F.concat(F.char(F.lit(65) + i), F.lit(". "), o))
    return F.concat(question, F.lit("\n"), F.array_join(lettered, "\n"), F.lit("\nAnswer within <answer> tags."))


#: Ways to state that a variable has a value.
ASSIGNMENTS = ("{n} = {v}", "let {n} be {v}", "set {n} to {v}", "the value of {n} is {v}")


def assignment_sentence(name: Column, value: Column, form: Column) -> Column:
    """One of four ways to say that a variable has a value; form counts from 0."""
    out = F.lit(None).cast("string")
    for i, template in reversed(list(enumerate(ASSIGNMENTS))):
        head, rest = template.split("{n}")
        middle, tail = rest.split("{v}")
        out = F.when(form == i, F.concat(F.lit(head), name, F.lit(middle), value, F.lit(tail))).otherwise(out)
    return out


def is_plain_word(word: Column) -> Column:
    """No space, hyphen or dot."""
    return ~word.rlike("[ .-]")


def sentences(text: Column) -> Column:
    """Pieces that end with a full stop, trimmed, blank ones dropped."""
    return F.filter(F.transform(F.split(text, r"\."), lambda s: squeeze(s)), lambda s: s != "")
