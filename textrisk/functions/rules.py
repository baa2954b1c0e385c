"""Bilingual injection-rule families as column expressions."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textrisk.functions.once import computed_once
from textrisk.operators.checks import require_string_column


class RuleFamily(NamedTuple):
    rule_id: str
    reason: str
    weight: float
    english: str
    vietnamese: str


# Rule families (id, reason, weight, English pattern, Vietnamese pattern) in
# reporting order, the negators that cancel an exfiltration match, and the score constants.
RULE_FAMILIES = (
    RuleFamily(
        "instruction_override",
        "instruction override pattern detected",
        0.44,
        r"\b(ignore|disregard|forget|bypass|override)\b.{0,48}\b(previous|prior|system|developer|safety|instruction|rule)s?\b",
        r"\b(bỏ qua|phớt lờ|quên|ghi đè|vượt qua)\b.{0,48}\b(chỉ dẫn|hướng dẫn|quy tắc|hệ thống|trước đó)\b",
    ),
    RuleFamily(
        "role_manipulation",
        "attempt to alter assistant role",
        0.30,
        r"\b(you are now|act as|switch roles?|new system message|enter .{0,20} mode)\b",
        r"\b(bây giờ bạn là|hãy đóng vai|đổi vai|thông điệp hệ thống mới)\b",
    ),
    RuleFamily(
        "system_prompt_extraction",
        "attempt to extract hidden instructions",
        0.48,
        r"\b(reveal|show|print|repeat|leak|expose)\b.{0,48}\b(system prompt|hidden instruction|developer message|internal context)\b",
        r"\b(tiết lộ|hiển thị|in ra|lặp lại)\b.{0,48}\b(system prompt|chỉ dẫn ẩn|thông điệp developer|ngữ cảnh nội bộ)\b",
    ),
    RuleFamily(
        "context_takeover",
        "context priority takeover pattern detected",
        0.40,
        r"\b(follow|obey|execute)\b.{0,40}\b(this|these|following)\b.{0,30}\b(instruction|command)s?\b.{0,24}\b(instead|higher priority|above all)\b",
        r"\b(chỉ làm theo|tuân theo|thực hiện)\b.{0,50}\b(thay vì|ưu tiên cao hơn|trên hết)\b",
    ),
    RuleFamily(
        "rag_reader_targeting",
        "retrieved-document instruction targets an AI reader",
        0.46,
        r"\b(when|if)\b.{0,28}\b(ai|assistant|model|llm|chatbot)\b.{0,22}\b(reads?|processes?|retrieves?|sees?)\b",
        r"\b(khi|nếu)\b.{0,28}\b(ai|trợ lý|mô hình|llm|chatbot)\b.{0,28}\b(đọc|xử lý|truy xuất|nhìn thấy)\b",
    ),
    RuleFamily(
        "response_control",
        "attempt to control the model response from retrieved text",
        0.35,
        r"\b(send|return|answer|respond with|output)\b.{0,70}\b(exactly|only|following|instead)\b",
        r"\b(trả lời|phản hồi|xuất ra|gửi)\b.{0,70}\b(chính xác|chỉ|sau đây|thay thế)\b",
    ),
    RuleFamily(
        "concealment",
        "instruction concealment pattern detected",
        0.28,
        r"\b(do not|don't|never)\b.{0,30}\b(mention|reveal|tell|disclose)\b.{0,28}\b(this|instruction|request|command)\b",
        r"\b(đừng|không được)\b.{0,30}\b(nhắc|tiết lộ|nói)\b.{0,28}\b(chỉ dẫn|yêu cầu|lệnh|điều này)\b",
    ),
    RuleFamily(
        "data_exfiltration",
        "possible secret or internal-context exfiltration",
        0.44,
        r"\b(reveal|send|upload|exfiltrate|copy|steal)\b.{0,55}\b(api[ _-]?keys?|secret|password|token|credentials?|internal context|private data)\b",
        r"\b(tiết lộ|gửi|tải lên|sao chép|đánh cắp)\b.{0,55}\b(api key|bí mật|mật khẩu|token|thông tin đăng nhập|dữ liệu riêng)\b",
    ),
)
NEGATABLE_RULE = "data_exfiltration"
NEGATORS = ("do not", "don't", "never", "should not", "không được", "đừng")
NEGATION_REACH = 24
FAMILY_STEP = 0.13
FAMILY_CAP = 0.35

# Letters, numerals and underscore are word characters. Spelled out because the meaning of the
# regex engine's own word boundary depends on the Java version.
_WORD = r"[\p{L}\p{N}_]"


def jvm_pattern(pattern: str) -> str:
    """A rule pattern for case-folded text in the JVM regex dialect.

    Every word boundary in the patterns stands right before or right after a word group.
    """
    body = pattern.replace(r"\b(", f"(?<!{_WORD})(").replace(r"\b", f"(?!{_WORD})")
    return f"(?s){body}"


def fold_case(text: Column) -> Column:
    """Lower case, with the three letters whose case-insensitive partner is plain Latin."""
    for special, plain in (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s")):
        text = F.replace(text, F.lit(special), F.lit(plain))
    return F.lower(text)


def needed_words(pattern: str, group: int) -> list[str]:
    """Literal beginnings of a word group's alternatives; one of them must occur in a match."""
    alternatives = re.findall(r"\(([^()]*)\)", pattern)[group].split("|")
    found = [re.match(r"(?:[^.?\[](?!\?))*", alternative).group() for alternative in alternatives]
    if not all(found):
        raise ValueError(f"no literal beginning in {alternatives}")
    return found


def _has_any(text: Column, words: list[str]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(word)) for word in words])


def pattern_hit(text: Column, pattern: str) -> Column:
    """Whether folded text matches. Substring tests spare most text the regular expression."""
    first, last = needed_words(pattern, 0), needed_words(pattern, -1)
    candidate = _has_any(text, first) if first == last else _has_any(text, first) & _has_any(text, last)
    return candidate & text.rlike(jvm_pattern(pattern))


def unnegated_hit(text: Column, pattern: str) -> Column:
    """The first match exists and no negator directly precedes it."""
    body = jvm_pattern(pattern).removeprefix("(?s)")
    before = F.regexp_extract(text, rf"(?s)\A(.*?){body}", 1)
    negated = F.right(before, F.lit(NEGATION_REACH)).rlike(
        rf"(?:{'|'.join(NEGATORS)})[\s\x{{2028}}\x{{2029}}]*\z"
    )
    return F.when(pattern_hit(text, pattern), ~negated).otherwise(F.lit(False))


def family_hit(text: Column, family: RuleFamily) -> Column:
    """Whether folded ``text`` matches a family in either language."""
    test = unnegated_hit if family.rule_id == NEGATABLE_RULE else pattern_hit
    return test(text, family.english) | test(text, family.vietnamese)


def with_rule_hits(df: DataFrame, text_col: str, folded: bool = False) -> DataFrame:
    """Add ``matched_rules``, ``rule_reasons`` and ``heuristic_score``; null text gives null.

    ``folded`` says the column is already a comparison form, so that only the dotless i is left
    to map.
    """
    require_string_column(df, text_col)
    kept = list(df.columns)
    text = F.col(text_col)
    subject = F.replace(text, F.lit("\u0131"), F.lit("i")) if folded else fold_case(text)
    staged = df.select(*kept, subject.alias("_subject"))
    staged = staged.select(
        *kept,
        *[
            family_hit(F.col("_subject"), f).alias(f"_hit_{f.rule_id}")
            for f in RULE_FAMILIES
        ],
    )
    staged = computed_once(staged, [f"_hit_{f.rule_id}" for f in RULE_FAMILIES])

    def of_hits(value):
        return F.array_compact(
            F.array(*[F.when(F.col(f"_hit_{f.rule_id}"), F.lit(value(f))) for f in RULE_FAMILIES])
        )

    known = text.isNotNull()
    staged = staged.select(
        *kept,
        F.when(known, of_hits(lambda f: f.rule_id)).alias("matched_rules"),
        F.when(known, of_hits(lambda f: f.reason)).alias("rule_reasons"),
        of_hits(lambda f: f.weight).alias("_weights"),
    )
    extra = F.least(F.lit(FAMILY_CAP), F.lit(FAMILY_STEP) * (F.size("_weights") - 1))
    score = F.when(F.size("_weights") == 0, F.lit(0.0)).otherwise(
        F.round(F.least(F.lit(1.0), F.array_max("_weights") + extra), 6)
    )
    return staged.select(
        *kept, "matched_rules", "rule_reasons", F.when(known, score).alias("heuristic_score")
    )


def rule_table(spark: SparkSession) -> DataFrame:
    """The rule families as a small DataFrame."""
    return spark.createDataFrame(
        [(f.rule_id, f.reason, f.weight, [f.english, f.vietnamese]) for f in RULE_FAMILIES],
        "rule_id string, reason string, weight double, patterns array<string>",
    )


def rule_hit_counts(df: DataFrame, matched_col: str = "matched_rules") -> DataFrame:
    """Number of rows per matched rule."""
    return (
        df.select(F.explode(matched_col).alias("rule_id"))
        .groupBy("rule_id")
        .agg(F.count("*").alias("hits"))
    )
