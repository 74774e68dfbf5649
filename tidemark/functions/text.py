"""Text rules as column expressions, and the two helpers that built-in functions can't state."""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab


def _any(words: Sequence[str]) -> str:
    return "|".join(re.escape(w) for w in words)


def first_rule(text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str | None) -> Column:
    """The name of the first rule with a word in the text."""
    out = F.lit(default)
    for name, words in reversed(rules):
        out = F.when(text.rlike(_any(words)), name).otherwise(out)
    return out


def category(*texts: Column) -> Column:
    """F32: a document's category by ordered words."""
    return first_rule(F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts]), vocab.CATEGORY_RULES, vocab.DEFAULT_CATEGORY)


def doc_id(value: Column) -> Column:
    """characters that an id can't have become _, none at the ends; `doc` if nothing is left."""
    # what stays is looked for, as in plain(); what stands at the ends goes with the _ there
    plain = F.btrim(F.array_join(F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit("[0-9a-zA-Z가-힣_.-]+"), F.lit(0)), "_"), F.lit("_"))
    return F.when(plain == "", "doc").otherwise(plain)


def plain(text: Column) -> Column:
    """letters, digits and Hangul only, lower case."""
    # to look for what stays is four times as fast as to look for what goes, whose class Java can't index
    return F.lower(F.array_join(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[a-zA-Z0-9가-힣]+"), F.lit(0)), ""))


def qa_text(topic: Column, title: Column, question: Column, answer: Column) -> Column:
    """text of a question-and-answer document."""
    part = lambda head, c: F.concat(F.lit(head), F.coalesce(c, F.lit("")))
    return F.concat_ws("\n", F.lit("문서 유형: QA 매칭 문서"), part("문서 주제: ", topic), part("관련 메뉴: ", title), part("사용자 질문: ", question), part("상세 답변: ", answer))


def cut_context(text: Column, most: int = 2000, least: float = 0.5) -> Column:
    """the first characters, back to the last full stop if that is past half."""
    head = F.substring(text, 1, most)
    stop = F.length(head) - F.instr(F.reverse(head), ".") + 1
    return F.when(F.length(text) <= most, text).when(head.contains(".") & (stop - 1 > most * least), F.substr(head, F.lit(1), stop)).otherwise(head)


def cut_block(text: Column, most: int = 1400) -> Column:
    """a document's text in a context, cut with an ellipsis."""
    own = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.length(own) > most, F.concat(F.rtrim(F.substring(own, 1, most)), F.lit("..."))).otherwise(own)


def route(question: Column) -> Column:
    """manual of a question, spaces removed; null if none."""
    return first_rule(F.replace(question, F.lit(" "), F.lit("")), vocab.MANUAL_ROUTES, None)


def buttons(question: Column, answer: Column, rules: Sequence[tuple[str, Sequence[str]]] | None = None) -> Column:
    """Distinct buttons for words of question and answer."""
    both = F.concat_ws(" ", question, answer)
    return F.array_distinct(F.array_compact(F.array(*[F.when(both.rlike(_any(words)), name) for name, words in rules or vocab.BUTTONS])))


def button_links(question: Column, answer: Column) -> Column:
    """Buttons as an array of (label, url), one for each label."""
    links = F.create_map(*[x for name, link in vocab.BUTTON_LINKS.items() for x in (F.lit(name), F.struct(F.lit(link[0]).alias("label"), F.lit(link[1]).alias("url")))])
    return F.transform(buttons(question, answer), lambda name: F.element_at(links, name))


def refined_query(reply: Column, original: Column, most: int = 500) -> Column:
    """a rewritten query without code fences: its first line that isn't blank, else the original."""
    lines = F.filter(F.transform(F.split(F.trim(F.replace(reply, F.lit("```"), F.lit(""))), "\n"), F.trim), lambda x: x != "")
    return F.coalesce(F.substring(F.get(lines, F.lit(0)), 1, most), original)


def needs_search(reply: Column) -> Column:
    """NEED_RAG or NO_RAG as the reply says, NEED_RAG by default."""
    return F.coalesce(F.nullif(F.regexp_extract(F.upper(F.trim(reply)), r"\b(NEED_RAG|NO_RAG)\b", 1), F.lit("")), F.lit("NEED_RAG"))


def page_url(base: str, text: Column, most: int = 500) -> Column:
    """address with the question, without control characters and tags."""
    own = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    own = F.substring(F.regexp_replace(own, "<[^>]+>", ""), 1, most)
    return F.when(own == "", base).otherwise(F.concat(F.lit(base + "?init_prompt="), F.url_encode(own)))


def safe_arguments(arguments: Column, most: int = 100) -> Column:
    """sensitive values masked, line ends shown, long values cut."""
    def value(k: Column, v: Column) -> Column:
        own = F.replace(v, F.lit("\n"), F.lit("\\n"))
        return F.when(F.lower(k).isin(*vocab.SENSITIVE_KEYS), "[REDACTED]").when(F.length(own) > most, F.concat(F.substring(own, 1, most), F.lit("..."))).otherwise(own)
    return F.transform_values(arguments, value)


def reply_json(reply: Column) -> Column:
    """JSON of a reply, else of its part in braces, else null; as JSON text."""
    part = F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit(""))
    return F.to_json(F.coalesce(F.try_parse_json(reply), F.try_parse_json(part)))


def judge_score(value: Column) -> Column:
    """a score from 1 to 5; what is no number counts as 1."""
    score = F.rint(value.try_cast("double"))
    return F.when(score.isNull(), 1).otherwise(F.greatest(F.least(score, F.lit(5.0)), F.lit(1.0))).cast("int")


BREAK = re.compile(r"[ \n.!?]")


def chunks_of(text: str | None, size: int, overlap: int) -> list[str]:
    """pieces of about `size` characters that share `overlap`, cut after a space or sentence end where there is one.

    A break counts from the character behind the piece back to its second one, and the nearest
    is taken; without one the cut is hard.
    """
    if size <= overlap:
        raise ValueError(f"size {size} must exceed overlap {overlap}")
    text = text or ""
    breaks = [m.start() for m in BREAK.finditer(text)]
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            nearest = breaks[i] if (i := bisect.bisect_right(breaks, end) - 1) >= 0 else -1
            if nearest > at:
                end = nearest + 1
        if piece := text[at:end].strip():
            out.append(piece)
        at = end - overlap if end - overlap > at else end
    return out


def chunker(size: int = 500, overlap: int = 50):
    """F36 as a pandas UDF: text to array of pieces."""
    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunks_of(t, size, overlap))

    return split


def bullets(value, depth: int = 0) -> str:
    """nested JSON as indented bullet lines, empty parts left out."""
    if value is None or value == "":
        return ""
    if not isinstance(value, (dict, list)):
        return str(value)
    pairs = [(f"{k}: ", v) for k, v in value.items()] if isinstance(value, dict) else [("", v) for v in value]
    shown = ((head, bullets(v, depth + 2).strip()) for head, v in pairs)
    return "\n".join(f"{' ' * depth}- {head}{body}" for head, body in shown if body)


def json_text_bullets(value: str | None) -> str:
    """F47 of JSON text; what isn't JSON is shown as it is."""
    try:
        return bullets(json.loads(value)) if value else ""
    except ValueError:
        return value


def json_bullets(value: Column) -> Column:
    """F47 as a pandas UDF."""
    @F.pandas_udf("string")
    def shown(values: pd.Series) -> pd.Series:
        return values.map(json_text_bullets)

    return shown(value)


def manual_text(item: Column, fields: Sequence[str] | None = None) -> Column:
    """text of a manual's item (a variant): head lines, then each priority field that isn't empty."""
    get = lambda name: F.try_variant_get(item, f"$.{name}", "string")
    words = F.coalesce(F.array_join(F.from_json(get("keywords"), "array<string>"), ", "), get("keywords"), F.lit(""))
    head = [F.lit("문서 유형: 원문 매뉴얼"), F.concat(F.lit("장/절: "), F.coalesce(get("chapter"), F.lit(""))), F.concat(F.lit("제목: "), F.coalesce(get("title"), F.lit(""))), F.concat(F.lit("키워드: "), words)]
    body = []
    for name in fields or vocab.MANUAL_FIELDS:
        shown = json_bullets(get(name))
        body.append(F.when(shown != "", F.concat(F.lit(f"{name}:\n"), shown)))
    return F.concat_ws("\n\n", *head, *body)
