"""The write gate: which texts are worth storing."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillet.functions.text import col, stripped

MIN_LENGTH = 10
# Patterns by layer. The noise layer looks at the lower-cased text, so its patterns with capitals never match.
NOISE = [
    r"^/[\w/]+\.\w+$",
    r"^[a-f0-9]{7,40}$",
    r"(?:fixed?|resolved?|completed?|done)\s+(?:bug|issue|error)",
    r"^commit\s+[a-f0-9]",
    r"temporary|temp fix|workaround",
]
NOISE_NEVER = [r"^PR\s*#\d+", r"^Running\s+tests?", r"^Build\s+(?:passed|failed)"]
CODE = [
    r"(?:class|def|function|import|from)\s+\w+",
    r"(?:\.py|\.js|\.ts|\.yaml|\.json|\.toml)\b.*(?:modified|updated|changed)",
    r"(?:error|traceback|exception):.*(?:line|file|module)",
    r'File\s+"[^"]+",\s+line\s+\d+',
]
TASK = [r"^(?:Phase|Step|阶段)\s*\d+\s*(?:完成|done|completed)", r"已(?:完成|修复|解决|处理)\s*[：:]", r"^\d+\s*(?:个|条)\s*(?:文件|commit|PR)"]
CHAT = [
    r"^(?:今天|昨晚|中午|早上)(?:吃了|喝了|看了|玩了).{2,10}$",
    r"^(?:好开心|好难过|好累|好困|好饿|哈哈|呵呵|嘻嘻)",
    r"^(?:天气|心情|感觉)(?:真|好|很|太).{1,6}$",
    r"^(?:我|他|她)(?:今天|昨天|刚才)(?:吃了|喝了|看了)",
]


#: What a text must contain, in one of the forms, for an unanchored pattern to match: found many times faster than the pattern.
NEEDS = {
    NOISE[2]: ["fix", "resolve", "complete", "done"],
    CODE[0]: ["class", "def", "function", "import", "from"],
    CODE[1]: [".py", ".js", ".ts", ".yaml", ".json", ".toml"],
    CODE[2]: ["error", "traceback", "exception"],
    CODE[3]: ["File"],
    TASK[1]: ["已"],
}
#: What a text must start with for an anchored pattern to match; a blank matches whatever kind of space follows.
STARTS = {
    NOISE[0]: ["/"],
    NOISE[3]: ["commit"],
    TASK[0]: ["Phase", "Step", "阶段"],
    CHAT[0]: ["今天", "昨晚", "中午", "早上"],
    CHAT[1]: ["好", "哈哈", "呵呵", "嘻嘻"],
    CHAT[2]: ["天气", "心情", "感觉"],
    CHAT[3]: ["我", "他", "她"],
}


def any_of(text: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns is found; a pattern runs only where the text can match it."""
    out = F.lit(False)
    for p in patterns:
        found = text.rlike(f"(?U){p}")
        if p in NEEDS:
            found = reduce(or_, [F.contains(text, F.lit(x)) for x in NEEDS[p]]) & found
        elif p in STARTS:
            found = reduce(or_, [text.startswith(x) for x in STARTS[p]]) & found
        elif p == NOISE[1]:
            found = (F.length(text) <= 41) & found  # $ lets one line end follow
        out = out | found
    return out


def reject_layer(text: Column | str, strict: bool = False) -> Column:
    """The first layer that rejects the text, or null. strict: the patterns that never match, on the text as it is, too."""
    t = stripped(F.coalesce(col(text), F.lit("")))

    def layers(t: Column) -> Column:
        noise = any_of(F.lower(t), NOISE)
        if strict:
            noise = noise | any_of(t, NOISE_NEVER)
        return F.when(F.length(t) < MIN_LENGTH, "length").when(noise, "noise").when(any_of(t, CODE), "code").when(any_of(t, TASK), "task").when(any_of(t, CHAT), "chat")

    return F.transform(F.array(t), layers)[0]  # t is computed once


def worth_storing(text: Column | str, strict: bool = False) -> Column:
    return reject_layer(text, strict).isNull()
