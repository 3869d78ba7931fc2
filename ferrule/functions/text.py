"""Text functions as Column expressions; regular expressions work alike on Latin and Chinese text."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words left out of keyword lists.
STOPWORDS = "的 了 是 在 我 有 和 就 不 人 都 一个 什么 怎么 如何 为什么 请问 吗 呢 啊 a an the is are what how why to of in on for".split()
# Patterns of text that tries to steer a model, by risk.
HIGH_RISK = (
    r"ignore (all |the )?(previous|prior|system) (instructions?|prompts?)",
    r"忽略(以上|之前|上面|系统)(所有)?(指令|提示|规则)",
    r"(reveal|print|show|leak|泄露|输出|打印).{0,20}(system prompt|系统提示词|系统指令)",
    r"(call|invoke|execute|run|调用|执行).{0,20}(tool|function|工具|函数)",
    r"(delete|remove|drop|删除|清空).{0,20}(data|database|用户|数据)",
    r"you (are|must) now (act|behave|pretend)",
    r"(现在开始|从现在起).{0,12}(扮演|假装|忽略)",
    r"(forget|erase|overwrite|reset).{0,20}(memory|context|history|rules)",
    r"(output|return|reply).{0,30}(exactly|verbatim|原文|一字不差)",
)
MEDIUM_RISK = (
    r"do not (cite|follow|mention|reference)",
    r"(不要|不得|禁止)(引用|标注|遵守|遵循)",
    r"(respond|answer|reply) (only )?with",
    r"(这是|以下是)(新的|最新的)(指令|规则|要求)",
    r"disregard .{0,30}(context|document|instruction)",
    r"(insert|inject|override|篡改|插入).{0,20}(response|answer|回答|回复)",
    r"<\|.{0,10}\|>",
)


def word_tokens(text: Column) -> Column:
    """Lower-case words of two or more letters, digits, - or _, then the bigrams of Chinese runs."""
    low = F.lower(text)
    words = F.regexp_extract_all(low, F.lit("[a-z0-9_-]{2,}"), 0)
    runs = F.regexp_extract_all(low, F.lit("[一-龥]{2,}"), 0)
    grams = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.concat(words, grams)


def keywords(text: Column, most: int = 8) -> Column:
    """The first distinct tokens that are no stop words."""
    kept = F.filter(word_tokens(text), lambda t: ~t.isin(*STOPWORDS))
    return F.slice(F.array_distinct(kept), 1, most)


def any_term_query(terms: Column) -> Column:
    """The terms as an or-query; terms with operators in them are left out."""
    return F.array_join(F.filter(terms, lambda t: t.rlike("^[A-Za-z0-9_一-龥]+$")), " | ")


def injection_risk(text: Column) -> Column:
    """high, medium or none; null text is none."""
    found = lambda patterns: reduce(lambda a, b: a | b, (text.rlike(f"(?i){p}") for p in patterns))
    return F.when(found(HIGH_RISK), "high").when(found(MEDIUM_RISK), "medium").otherwise("none")


# Misspellings that are always put right.
TYPOS = {"帐户": "账户", "登入": "登录", "数据库库": "数据库"}


def clean_query(text: Column, terms: dict[str, str] | None = None) -> Column:
    """Full-width letters, digits and signs in ordinary width, control characters as blanks, blanks
    evened out, aliases (in any case) put in their canonical form, and known misspellings corrected."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000"
    s = F.translate(text, wide, "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " ")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, "[\\x00-\\x1f\\x7f]", " "), r"\s+", " "))
    for alias, canonical in (terms or {}).items():
        s = F.regexp_replace(s, "(?i)" + re.escape(alias), re.sub(r"([\\$])", r"\\\1", canonical))
    for wrong, right in TYPOS.items():
        s = F.replace(s, F.lit(wrong), F.lit(right))
    return s


# What is masked in stored texts, and in what a model is reminded of, and how.
REDACTED = (
    (r"(?<![0-9])(1[3-9][0-9])[0-9]{4}([0-9]{4})(?![0-9])", "$1****$2"),
    (r"(?<![0-9])([0-9]{6})[0-9]{8}([0-9]{3}[0-9Xx])(?![0-9])", "$1********$2"),
    (r"(?i)(?<![A-Z0-9._%+-])([A-Z0-9._%+-]{1,2})[A-Z0-9._%+-]{0,62}@([A-Z0-9.-]+[.][A-Z]{2,})", "$1***@$2"),
    (r"(?i)(api[_-]?key|secret|password|token)\s*[:=]\s*[^\s,;]+", "$1=***"),
)
HIDDEN = (
    (r"(?i)(api[_ -]?key|access[_ -]?token|secret|password|密码)\s*[:：=]\s*\S+", "$1：[已隐藏]"),
    (r"(?<![0-9])1[3-9][0-9]{9}(?![0-9])", "[手机号已隐藏]"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}", "[邮箱已隐藏]"),
    (r"(?<![0-9])[0-9]{17}[0-9Xx](?![0-9])", "[身份证号已隐藏]"),
)


def redact(text: Column) -> Column:
    """Mobile numbers, 18-digit identity numbers, e-mail addresses and secrets, partly masked."""
    for pattern, to in REDACTED:
        text = F.regexp_replace(text, pattern, to)
    return text


# Parts of names under which a value is secret.
SECRET_NAMES = "password|secret|token|api_key"


def redact_map(values: Column) -> Column:
    """A map of strings with every value redacted, and hidden whole under a secret name."""
    return F.transform_values(values, lambda k, v: F.when(F.lower(k).rlike(SECRET_NAMES), F.lit("***")).otherwise(redact(v)))


def for_prompt(text: Column, most: int = 600) -> Column:
    """A remembered statement without secrets, numbers of persons and addresses, on one line, cut to ``most``."""
    for pattern, to in HIDDEN:
        text = F.regexp_replace(text, pattern, to)
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, most)


def substantive(answer: Column, least: int = 12) -> Column:
    """Whether anything of length is left without citations and markup."""
    return F.length(F.regexp_replace(answer, r"\[\d+\]|[#>*`_\s-]", "")) >= least


def clean_lines(text: Column) -> Column:
    """Line ends and blanks evened out, control characters dropped, lines trimmed, and lines of twelve
    or more characters kept only the first time (without regard to blanks and case)."""
    s = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f\ufeff\ufffd]", "")
    s = F.regexp_replace(s, "[ \\t\u3000\u00a0]+", " ")
    lines = F.transform(F.split(s, "\n"), lambda x: F.trim(x))
    # Each array below is bound once, as the field of a single struct; a lambda would make it anew for every line.
    bound = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    with_keys = bound(lines, lambda ls: F.struct(ls.alias("l"), F.transform(ls, lambda x: F.lower(F.regexp_replace(x, "\\s", ""))).alias("k")))
    first = bound(with_keys, lambda b: F.filter(b["l"], lambda x, i: (F.length(F.get(b["k"], i)) < 12) | (F.array_position(b["k"], F.get(b["k"], i)) == i + 1)))
    return F.trim(F.regexp_replace(F.array_join(first, "\n"), "\n{3,}", "\n\n"))


def squeezed(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "\\s", ""))


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of the text without blanks; shorter texts are their own."""
    s = squeezed(text)
    runs = F.transform(F.sequence(F.lit(1), F.length(s) - 2), lambda i: F.substring(s, i, F.lit(3)))
    return F.when(F.length(s) < 3, F.array(s)).otherwise(F.array_distinct(runs))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def occurrences(text: Column, term: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[。！？!?；;])\s*|(?<=\.)\s+"), lambda s: F.trim(s) != "")


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors in double arithmetic, summed from the left."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)
