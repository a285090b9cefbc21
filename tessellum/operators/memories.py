"""Memory types of text segments, by counts of regular expressions; sentiment; name candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.functions.text import sentiment, strip

# Expressions that speak for a memory type, in order of declaration.
MARKERS = {
    "decision": [
        r"\blet'?s (use|go with|try|pick|choose|switch to)\b", r"\bwe (should|decided|chose|went with|picked|settled on)\b", r"\bi'?m going (to|with)\b", r"\bbetter (to|than|approach|option|choice)\b", r"\binstead of\b", r"\brather than\b",
        r"\bthe reason (is|was|being)\b", r"\bbecause\b", r"\btrade-?off\b", r"\bpros and cons\b", r"\bover\b.*\bbecause\b", r"\barchitecture\b", r"\bapproach\b", r"\bstrategy\b", r"\bpattern\b", r"\bstack\b", r"\bframework\b",
        r"\binfrastructure\b", r"\bset (it |this )?to\b", r"\bconfigure\b", r"\bdefault\b",
    ],
    "preference": [
        r"\bi prefer\b", r"\balways use\b", r"\bnever use\b", r"\bdon'?t (ever |like to )?(use|do|mock|stub|import)\b", r"\bi like (to|when|how)\b", r"\bi hate (when|how|it when)\b", r"\bplease (always|never|don'?t)\b",
        r"\bmy (rule|preference|style|convention) is\b", r"\bwe (always|never)\b", r"\bfunctional\b.*\bstyle\b", r"\bimperative\b", r"\bsnake_?case\b", r"\bcamel_?case\b", r"\btabs\b.*\bspaces\b", r"\bspaces\b.*\btabs\b", r"\buse\b.*\binstead of\b",
    ],
    "milestone": [
        r"\bit works\b", r"\bit worked\b", r"\bgot it working\b", r"\bfixed\b", r"\bsolved\b", r"\bbreakthrough\b", r"\bfigured (it )?out\b", r"\bnailed it\b", r"\bcracked (it|the)\b", r"\bfinally\b", r"\bfirst time\b", r"\bfirst ever\b",
        r"\bnever (done|been|had) before\b", r"\bdiscovered\b", r"\brealized\b", r"\bfound (out|that)\b", r"\bturns out\b", r"\bthe key (is|was|insight)\b", r"\bthe trick (is|was)\b", r"\bnow i (understand|see|get it)\b", r"\bbuilt\b", r"\bcreated\b",
        r"\bimplemented\b", r"\bshipped\b", r"\blaunched\b", r"\bdeployed\b", r"\breleased\b", r"\bprototype\b", r"\bproof of concept\b", r"\bdemo\b", r"\bversion \d", r"\bv\d+\.\d+", r"\d+x (compression|faster|slower|better|improvement|reduction)",
        r"\d+% (reduction|improvement|faster|better|smaller)",
    ],
    "problem": [
        r"\b(bug|error|crash|fail|broke|broken|issue|problem)\b", r"\bdoesn'?t work\b", r"\bnot working\b", r"\bwon'?t\b.*\bwork\b", r"\bkeeps? (failing|crashing|breaking|erroring)\b", r"\broot cause\b", r"\bthe (problem|issue|bug) (is|was)\b",
        r"\bturns out\b.*\b(was|because|due to)\b", r"\bthe fix (is|was)\b", r"\bworkaround\b", r"\bthat'?s why\b", r"\bthe reason it\b", r"\bfixed (it |the |by )\b", r"\bsolution (is|was)\b", r"\bresolved\b", r"\bpatched\b", r"\bthe answer (is|was)\b",
        r"\b(had|need) to\b.*\binstead\b",
    ],
}
EMOTIONAL = [
    r"\blove\b", r"\bscared\b", r"\bafraid\b", r"\bproud\b", r"\bhurt\b", r"\bhappy\b", r"\bsad\b", r"\bcry\b", r"\bcrying\b", r"\bmiss\b", r"\bsorry\b", r"\bgrateful\b", r"\bangry\b", r"\bworried\b", r"\blonely\b",
    r"\bbeautiful\b", r"\bamazing\b", r"\bwonderful\b", r"i feel", r"i'm scared", r"i love you", r"i'm sorry", r"i can't", r"i wish", r"i miss", r"i need", r"never told anyone", r"nobody knows", r"\*[^*]+\*",
]
# Lines of code among prose, and lines at which a speaker's turn begins.
CODE_LINES = [
    r"^\s*[\$#]\s", r"^\s*(cd|source|echo|export|pip|npm|git|python|bash|curl|wget|mkdir|rm|cp|mv|ls|cat|grep|find|chmod|sudo|brew|docker)\s", r"^\s*```", r"^\s*(import|from|def|class|function|const|let|var|return)\s", r"^\s*[A-Z_]{2,}=", r"^\s*\|",
    r"^\s*[-]{2,}", r"^\s*[{}\[\]]\s*$", r"^\s*(if|for|while|try|except|elif|else:)\b", r"^\s*\w+\.\w+\(", r"^\s*\w+ = \w+\.\w+",
]
TURNS = [r">\s", r"(?i:Human|User|Q)\s*:", r"(?i:Assistant|AI|A|Claude|ChatGPT)\s*:"]
LEAST_TURNS, GROUP_LINES, BIG_BLOCK_LINES = 3, 25, 20
LEAST_LETTERS, LETTERS_FROM = 0.4, 10
DEFAULT_TYPES = ("decision", "preference", "milestone", "problem")
RESOLVED = [r"\bfixed\b", r"\bsolved\b", r"\bresolved\b", r"\bpatched\b", r"\bgot it working\b", r"\bit works\b", r"\bnailed it\b", r"\bfigured (it )?out\b", r"\bthe (fix|answer|solution)\b"]
LONG_CHARS, LONGER_CHARS = 200, 500


def marker_score(text: Column, markers: list[str]) -> Column:
    """Sum of the matches of all markers."""
    low = F.lower(text)
    return sum((F.regexp_count(low, F.lit(m)) for m in markers), F.lit(0))


def prose(text: Column) -> Column:
    """A text without fenced blocks and lines of code; the whole text if nothing else is left."""
    open_text = F.regexp_replace(text, r"(?m)^[^\S\n]*```[\s\S]*?(?:\n[^\S\n]*```[^\n]*|\z)", "")

    def plain(line: Column) -> Column:
        bare = strip(line)
        few = (F.length(F.regexp_replace(bare, r"[^\p{L}]", "")) < LEAST_LETTERS * F.length(bare)) & (F.length(bare) > LETTERS_FROM)
        return ~(bare.rlike("|".join(f"(?:{p})" for p in CODE_LINES)) | few)

    kept = strip(F.array_join(F.filter(F.split(open_text, "\n"), plain), "\n"))
    return F.when(kept != "", kept).otherwise(text)


def segments(text: Column) -> Column:
    """Parts of a text: turns of speakers where there are three and more, else paragraphs; a single long one by 25 lines."""
    turn = "(?:" + "|".join(TURNS) + ")"
    lines = F.split(text, "\n")
    turns = F.size(F.filter(lines, lambda x: strip(x).rlike("^" + turn)))
    by_turn = F.transform(F.split(text, rf"(?m)(?=^[^\S\n]*{turn})"), lambda x: F.regexp_replace(x, r"\n\z", ""))
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda x: x != "")
    starts = F.sequence(F.lit(1), F.size(lines), F.lit(GROUP_LINES))
    groups = F.filter(F.transform(starts, lambda k: strip(F.array_join(F.slice(lines, k, GROUP_LINES), "\n"))), lambda x: x != "")
    return F.when(turns >= LEAST_TURNS, by_turn).when((F.size(paragraphs) <= 1) & (F.size(lines) > BIG_BLOCK_LINES), groups).otherwise(paragraphs)


def memory_types(segments: DataFrame, text_col: str = "content", least: float = 0.3, types: tuple[str, ...] = DEFAULT_TYPES) -> DataFrame:
    """Segments of 20 characters and more with ``memory_type`` and ``confidence``.

    Only the prose of a segment is scored. The type of most matches wins (the earlier declared of equals); a solved problem
    is a milestone, or emotional where that is asked for and the mood is good; so is one in a good mood that has signs of
    these. A bonus for length enters the confidence only, and only confidences of ``least`` and more stay. Null segments
    give none.
    """
    known = MARKERS | {"emotional": EMOTIONAL}
    unknown = set(types) - set(known)
    if unknown:
        raise ValueError(f"unknown types: {', '.join(sorted(unknown))}")
    rows = segments.filter(F.length(strip(F.col(text_col))) >= 20).withColumn("_prose", prose(F.col(text_col)))
    scored = F.array(*[F.struct(marker_score(F.col("_prose"), known[name]).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, name in enumerate(dict.fromkeys(types))])
    best = rows.withColumn("_all", scored).withColumn("_best", F.array_max("_all")).filter(F.col("_best")["n"] > 0)
    bonus = F.when(F.length(text_col) > LONGER_CHARS, 2).when(F.length(text_col) > LONG_CHARS, 1).otherwise(0)
    solved = F.lower("_prose").rlike("|".join(RESOLVED))
    good = sentiment(F.col("_prose")) == "positive"
    some = {t: _scores(t) for t in ("milestone", "emotional")}
    problem = F.col("_best")["name"] == "problem"
    kind = F.when(problem & solved & good & some["emotional"], "emotional").when(problem & (solved | (good & some["milestone"])), "milestone").when(problem & good & some["emotional"], "emotional").otherwise(F.col("_best")["name"])
    out = best.withColumn("memory_type", kind).withColumn("confidence", F.least(F.lit(1.0), (F.col("_best")["n"] + bonus) / 5.0))
    return out.filter(F.col("confidence") >= least).drop("_best", "_all", "_prose")


def _scores(kind: str) -> Column:
    return F.exists("_all", lambda x: (x["name"] == kind) & (x["n"] > 0))


def extract_memories(docs: DataFrame, keep: list[str], text_col: str = "text", least: float = 0.3, types: tuple[str, ...] = DEFAULT_TYPES) -> DataFrame:
    """``keep``, ``content``, ``memory_type``, ``confidence`` and ``chunk_index`` (of those that stay) of whole texts."""
    parts = docs.select(*keep, F.posexplode(segments(F.coalesce(F.col(text_col), F.lit("")))).alias("_pos", "content"))
    found = memory_types(parts, "content", least, types)
    nth = F.row_number().over(Window.partitionBy(*keep).orderBy("_pos")) - 1
    return found.select(*keep, nth.alias("chunk_index"), strip(F.col("content")).alias("content"), "memory_type", "confidence")


def name_candidates(docs: DataFrame, stop: list[str], text_col: str = "text", least: int = 3) -> DataFrame:
    """``(name, frequency)`` of capitalised words, and of phrases of several, that come ``least`` times and more over all
    texts. Stop words are no names, and a phrase with one isn't either."""
    edge = r"[\p{L}\p{N}_]"
    single = F.filter(F.split(F.col(text_col), r"[^\p{L}\p{N}_]+"), lambda w: w.rlike("^[A-Z][a-z]{1,19}$"))
    several = F.regexp_extract_all(F.col(text_col), F.lit(rf"(?<!{edge})([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)(?!{edge})"), F.lit(1))
    none = F.array(*map(F.lit, stop)).cast("array<string>")
    named = docs.select(F.explode(F.concat(single, several)).alias("name")).filter(~F.arrays_overlap(F.split(F.lower("name"), r"\s+"), none))
    return named.groupBy("name").agg(F.count("*").alias("frequency")).filter(F.col("frequency") >= least)
