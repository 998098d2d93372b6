"""Text scalars as Spark columns: tokens, n-grams, extraction of answers, prompts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space of any script, as a class spelled out that Java and Python read alike; Java's ``(?U)`` takes three times as long.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
TOKEN = rf"[a-z]+|[0-9]+|\\[a-z]+|[^{SPACE}]"
#: Subjects and the words that tell them.
TOPICS = {
    "algebra": ["equation", "solve", "variable", "polynomial", "root", "factor"],
    "geometry": ["triangle", "circle", "area", "perimeter", "angle", "polygon"],
    "number_theory": ["prime", "divisor", "modulo", "gcd", "integer", "divisible"],
    "combinatorics": ["choose", "permutation", "combination", "ways", "arrange", "count"],
    "calculus": ["integral", "derivative", "limit", "continuous", "differentiate"],
    "probability": ["probability", "expected", "random", "dice", "coin", "chance"],
}


def tokens(c: Column) -> Column:
    """Lower-case words, numbers, backslash commands and single marks."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def ngrams(words: Column, n: int) -> Column:
    """All runs of n words as space-joined strings; none if there are fewer.

    Shifted copies are zipped: a lambda that sliced ``words`` would evaluate it anew for each run.
    """
    runs = F.greatest(F.size(words) - n + 1, F.lit(0))
    out = F.slice(words, F.lit(1), runs)
    for k in range(1, n):
        out = F.zip_with(out, F.slice(words, F.lit(k + 1), runs), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def latex_commands(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\\([a-zA-Z]+)"), F.lit(1))


def mentions(c: Column, words: list[str]) -> Column:
    """Whether any word is a substring of the lower-cased text."""
    low, hit = F.lower(c), F.lit(False)
    for w in words:
        hit = hit | F.contains(low, F.lit(w))
    return hit


def strip(c: Column) -> Column:
    """Without white space at both ends, as Python's ``strip``."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def non_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def answer_type(c: Column) -> Column:
    """Kind of a short answer; the first that fits."""
    raw = F.coalesce(c, F.lit(""))
    a = strip(raw)
    return (
        F.when(raw == "", "empty")
        .when(a.rlike(r"^-?\d+$"), "integer")
        .when(a.rlike(r"^-?\d+\.\d+$"), "decimal")
        .when(a.rlike(r"^-?\d+/\d+$") | F.contains(raw, F.lit("\\frac")), "fraction")
        .when(F.lower(raw).rlike("[a-z]") & ~F.startswith(raw, F.lit("\\")), "symbolic")
        .when(F.contains(raw, F.lit("\\")), "latex_expression")
        .otherwise("other")
    )


def has_boxed(c: Column) -> Column:
    return F.contains(c, F.lit("\\boxed{"))


def boxed_naive(c: Column) -> Column:
    """Up to the first closing brace: nested braces cut it short."""
    return non_empty(F.regexp_extract(c, r"\\boxed\{([^}]+)\}", 1))


def balanced_answer(text: str | None, tagged: bool = True) -> str | None:
    """Content of the first box with its braces balanced, else of an answer tag, else None."""
    if text is None:
        return None
    at = text.find("\\boxed{")
    if at >= 0:
        depth, start = 1, at + 7
        for k in range(start, len(text)):
            depth += (text[k] == "{") - (text[k] == "}")
            if not depth:
                return text[start:k].strip()
    if tagged:
        _, opened, rest = text.partition("<answer>")
        inside, closed, _ = rest.partition("</answer>")
        if opened and closed:
            return inside.strip()
    return None


def balanced_answers(texts: pa.Array) -> pa.Array:
    """``balanced_answer`` of a whole batch.

    All braces of the batch are one sequence of steps up and down; the brace that closes a
    box is the next one at which the running depth falls to where it was before the box.
    """
    texts = texts.cast(pa.large_string())
    start = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    begin, end = int(start[0]) if len(start) else 0, int(start[-1]) if len(start) else 0
    opening, closing = (np.flatnonzero(data[begin:end] == ord(c)) + begin for c in "{}")
    at = np.concatenate([opening, closing])
    order = np.argsort(at, kind="stable")
    step = np.concatenate([np.ones(len(opening), np.int64), np.full(len(closing), -1)])[order]
    at, depth = at[order], np.cumsum(step)
    # The first box of each text, as the place of its brace among all braces.
    box = pc.find_substring(texts, "\\boxed{").fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(box >= 0)
    brace = np.searchsorted(at, start[rows] + box[rows] + 6)
    # Closing braces by depth, then place: the next of the same depth is the partner.
    ends = np.flatnonzero(step < 0)
    ends = ends[np.lexsort((ends, depth[ends]))]
    lowest = int(depth.min()) if len(depth) else 0
    key = lambda d, k: (d - lowest + 1) * (len(at) + 1) + k
    found = np.searchsorted(key(depth[ends], ends), key(depth[brace] - 1, brace)) if len(ends) else np.zeros(len(rows), np.int64)
    partner = ends[np.minimum(found, len(ends) - 1)] if len(ends) else np.zeros(len(rows), np.int64)
    whole = (found < len(ends)) & (depth[partner] == depth[brace] - 1) & (partner > brace) & (at[partner] < start[rows + 1]) if len(ends) else np.zeros(len(rows), bool)
    out: list[str | None] = [None] * len(texts)
    for row, a, b in zip(rows[whole].tolist(), (at[brace[whole]] + 1).tolist(), at[partner[whole]].tolist(), strict=True):
        out[row] = data[a:b].tobytes().decode().strip()
    left = np.ones(len(texts), bool)
    left[rows[whole]] = False
    tags = pc.match_substring(texts, "<answer>").fill_null(False).to_numpy(zero_copy_only=False)
    for row in np.flatnonzero(left & tags).tolist():
        out[row] = balanced_answer(texts[row].as_py())
    return pa.array(out, pa.string())


@F.arrow_udf(StringType())
def boxed_answer(texts: pa.Array) -> pa.Array:
    """``balanced_answer`` of a column: balancing braces isn't regular, so no pattern does it."""
    return balanced_answers(texts)


def _last(found: Column) -> Column:
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def mcq_choice(c: Column) -> Column:
    """The last ``answer: X``, else the last lone letter A to D, else the first character; upper case."""
    text = strip(F.coalesce(c, F.lit("")))
    named = _last(F.regexp_extract_all(text, F.lit(r"[Aa]nswer\s*:\s*([A-Da-d])\b"), F.lit(1)))
    lone = _last(F.regexp_extract_all(text, F.lit(r"\b([A-Da-d])\b"), F.lit(1)))
    return F.upper(F.coalesce(named, lone, F.substring(text, 1, 1)))


def gold_choice(key: Column, answer: Column) -> Column:
    return F.upper(strip(F.coalesce(non_empty(key), answer, F.lit(""))))


def marked_gold(c: Column) -> Column:
    """What follows the last ``####``, or all of it."""
    return strip(F.element_at(F.split(c, "####"), -1))


def marked_gold_line(c: Column) -> Column:
    """What follows the first ``####`` on its line; empty without one."""
    return strip(F.regexp_extract(c, r"####\s*(.+)", 1))


def last_number(c: Column) -> Column:
    return F.replace(_last(F.regexp_extract_all(c, F.lit(r"-?\d[\d,]*\.?\d*"), F.lit(0))), F.lit(","), F.lit(""))


def last_number_plain(c: Column) -> Column:
    """As ``last_number`` but commas split numbers, a plus sign counts, and none is empty."""
    return F.coalesce(_last(F.regexp_extract_all(c, F.lit(r"[-+]?\d*\.?\d+"), F.lit(0))), F.lit(""))


def function_key(c: Column) -> Column:
    """Function names compare without case, underscores, hyphens and spaces."""
    return F.translate(F.lower(strip(F.coalesce(c, F.lit("")))), "_- ", "")


def action(c: Column) -> Column:
    """Struct of a tool call's function and parameters (up to a blank line or the next action).

    ``parsed`` holds the parameters as a value if they are JSON, else null; ``params`` their text.
    """
    name = strip(non_empty(F.regexp_extract(c, r"Action:\s*([^\n]+)", 1)))
    params = strip(non_empty(F.regexp_extract(c, r"(?s)Action Input:\s*(.+?)(?:\n\n|\n(?=Action:)|\z)", 1)))
    return F.struct(name.alias("function"), params.alias("params"), F.try_parse_json(params).alias("parsed"))


def agent_step(c: Column, finish: str = "Final Answer:") -> Column:
    """Struct of an agent's output: ``status`` finish, action or error, with what was found."""
    final = non_empty(strip(F.element_at(F.split(c, finish), -1)))
    call = action(c)
    done = F.contains(c, F.lit(finish))
    return F.struct(
        F.when(done, "finish").when(call["function"].isNotNull() & call["params"].isNotNull(), "action").otherwise("error").alias("status"),
        F.when(done, final).alias("answer"),
        F.when(~done, call["function"]).alias("function"),
        F.when(~done, call["params"]).alias("params"),
    )


def json_part(c: Column) -> Column:
    """From the first opening to the last closing bracket; null without them."""
    return non_empty(F.regexp_extract(c, r"(?s)[{\[].*[}\]]", 0))


def judgement(c: Column) -> Column:
    """A judge's two words, looked for after the first results heading if there is one."""
    at = F.instr(c, "## Results")
    rest = F.when(at > 0, F.substring(c, at + 10, F.length(c))).otherwise(c)
    return F.struct(
        F.regexp_extract(rest, r"Process Correctness: (\w+)", 1).alias("process"),
        F.regexp_extract(rest, r"Final Response Correctness: (\w+)", 1).alias("final"),
    )


def instruction_list(c: Column) -> Column:
    """Lines without blanks, numbering and enclosing quotes."""
    lines = F.filter(F.transform(F.split(strip(c), "\n"), strip), lambda x: x != "")
    bare = F.transform(lines, lambda x: F.regexp_replace(x, r"^\d*\.\s*", ""))
    return F.transform(bare, lambda x: F.when(x.rlike('^".*"$') & (F.length(x) > 1), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x))


def sentence_end(c: Column) -> Column:
    """A full stop added where the text is neither blank nor has one."""
    return F.when((strip(c) != "") & ~F.endswith(c, F.lit(".")), F.concat(c, F.lit("."))).otherwise(c)


def braces_doubled(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))


def response_parts(c: Column) -> Column:
    """Status code, response and explanation of a simulated call."""
    rest = F.split_part(c, F.lit("Response:"), F.lit(2))
    return F.struct(
        non_empty(F.regexp_extract(c, r"Status Code:\s*(\d+)", 1)).cast("int").alias("status"),
        strip(F.split_part(rest, F.lit("Explanation:"), F.lit(1))).alias("response"),
        strip(F.split_part(rest, F.lit("Explanation:"), F.lit(2))).alias("explanation"),
    )


def chat(system: Column, user: Column, assistant: Column) -> Column:
    """The messages of a training example."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(turn("system", system), turn("user", user), turn("assistant", assistant))


def code_prompt(instruction: Column, given: Column) -> Column:
    blank = strip(F.coalesce(given, F.lit(""))) == ""
    return F.when(blank, instruction).otherwise(F.concat(instruction, F.lit("\n\nInput:\n"), given))


def answer_sentence(c: Column) -> Column:
    return F.concat(F.lit("The answer is \\boxed{"), c, F.lit("}."))


def mcq_prompt(question: Column, choices: Column) -> Column:
    """The question and at most four labelled choices, one to a line."""
    labelled = F.transform(F.slice(choices, 1, 4), lambda x, i: F.concat(F.get(F.array(*map(F.lit, "ABCD")), i), F.lit(". "), x))
    return F.concat(question, F.lit("\n"), F.array_join(labelled, "\n"))


def cut_and_answer(c: Column, answer: Column, most: int = 1500) -> Column:
    """A long solution is cut and ends in its answer; a short one stays."""
    cut = F.regexp_replace(F.substring(c, 1, most), r"(?U)\s+$", "")
    return F.when(F.length(c) > most, F.concat(cut, F.lit("\n\nTherefore, the answer is \\boxed{"), answer, F.lit("}."))).otherwise(c)


def request_text(url: Column, method: Column, headers: Column, body: Column) -> Column:
    """A call as a command line."""
    lines = F.transform(F.map_entries(headers), lambda e: F.concat(F.lit(' -H "'), e["key"], F.lit(": "), e["value"], F.lit('"')))
    data = F.when(body.isNotNull(), F.concat(F.lit(" -d '"), body, F.lit("'"))).otherwise("")
    return F.concat(F.lit("curl -X "), F.upper(method), F.lit(" "), url, F.array_join(lines, ""), data)


def filled(template: str, values: dict[str, Column]) -> Column:
    """A template's ``$name`` places filled."""
    out = F.lit(template)
    for name in sorted(values, key=len, reverse=True):
        out = F.replace(out, F.lit(f"${name}"), F.coalesce(values[name].cast("string"), F.lit("")))
    return out


def rightmost_replaced(c: Column, old: str, new: Column) -> Column:
    """``c`` with only the last occurrence of ``old`` replaced."""
    parts = F.split(c, "\\Q" + old + "\\E")
    head = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), old)
    return F.when(F.size(parts) > 1, F.concat(head, new, F.element_at(parts, -1))).otherwise(c)
