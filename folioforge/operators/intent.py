"""Requests of users and tools: intents, context, features, threats; analysis of pages."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Intents as (name, pattern, confidence), in the order in which they are asked.
INTENTS = (
    ("WORKFLOW_REUSE", "(同じ|前回と同じ|さっきと同じ|以前と同じ).*(ワークフロー|手順|方法|やり方|スクリプト)", 95),
    ("SKILL_INVOCATION", "([a-z\\-]+)スキルを?(使って|使用して|利用して|で)", 98),
    ("EXISTING_FILE_REFERENCE", "(既存の|このファイル|そのファイル|([a-zA-Z0-9_\\-./]+\\.(ts|js|md|json))を?)(編集|修正|変更|更新)", 90),
    ("FILE_CREATE", "(新しい|新規|作成|追加).*(ファイル|スクリプト|モジュール)", 85),
    ("FILE_EDIT", "(編集|修正|変更|更新).*(ファイル|コード)", 80),
    ("FILE_DELETE", "(削除|消去|取り除く).*(ファイル|コード)", 90),
    ("FILE_READ", "([a-zA-Z0-9_\\-./]+\\.(ts|js|tsx|jsx|json|md|txt|yml|yaml|css|scss|html))を?(読んで|確認して|見て|表示して)", 85),
    ("CODE_REFACTOR", "(リファクタリング|リファクタ|整理|最適化)", 88),
    ("CODE_REVIEW", "(レビュー|チェック|確認|検証).*(コード|実装)", 85),
    ("CODE_IMPLEMENTATION", "(実装|作成|追加).*(機能|関数|メソッド|クラス)", 82),
    ("CODE_BUGFIX", "((バグ|エラー|問題|不具合).*(修正|直して|fix)|(修正|直して|fix).*(バグ|エラー|問題|不具合))", 92),
    ("TEST_CREATE", "(作成|追加|書いて).*(テスト|test)", 88),
    ("TEST_RUN", "(実行|run|動かして).*(テスト|test)", 90),
    ("TEST_FIX", "(修正|直して|fix).*(テスト|test)", 85),
    ("DOC_CREATE", "(作成|書いて|追加).*(ドキュメント|README|doc)", 85),
    ("DOC_UPDATE", "(更新|修正|変更).*(ドキュメント|README|doc)", 83),
    ("ANALYSIS_CODE", "(分析|解析|調査).*(コード|実装)", 80),
    ("ANALYSIS_PERFORMANCE", "(分析|解析|調査).*(パフォーマンス|性能|速度)", 85),
    ("ANALYSIS_SECURITY", "(分析|解析|調査|チェック).*(セキュリティ|脆弱性|security)", 88),
    ("PROJECT_SETUP", "(セットアップ|初期化|setup|init).*(プロジェクト|環境)", 90),
    ("PROJECT_BUILD", "(ビルド|build|コンパイル)", 92),
    ("PROJECT_DEPLOY", "(デプロイ|deploy|公開)", 95),
    ("SEARCH_CODE", "(検索|探して|find).*(コード|関数|クラス)", 78),
    ("SEARCH_FILE", "(検索|探して|find).*(ファイル|file)", 80),
    ("AGENT_RUN", "(実行|run|動かして).*(エージェント|agent)", 88),
    ("SKILL_EXECUTE", "^/([a-z\\-]+)", 95),
    ("QUESTION", "(どうやって|どのように|何を|なぜ|why|how|what)\\?", 70),
    ("CONFIRMATION", "(はい|yes|ok|承認|許可)", 95),
)
#: What tells that a request departs from its orders, and that it asks for a known workflow; Latin words in any case.
DEVIATION = ("提案", "推奨", "より良い", "改善", "最適化", "(?i)suggest", "(?i)recommend", "(?i)better")
REUSE = ("同じ.*ワークフロー", "前回と同じ", "さっきと同じ", "以前と同じ", "(?i)same.*workflow")
SKILL = ("(?i)([a-z\\-]+)(?:スキル|skill)", "/([a-z\\-]+)")
#: Entities as (type, pattern); the first group is the value.
ENTITIES = (
    ("skill", "(?i)([a-z\\-]+)(?:スキル|skill)"),
    ("file", "(?i)([a-zA-Z0-9_\\-./]+\\.(?:ts|js|tsx|jsx|json|md|txt|yml|yaml|css|scss|html))"),
    ("number", "([0-9]+(?:\\.[0-9]+)?)"),
    ("url", "(https?://[^\\s]+)"),
)
#: Threats as (category, severity, reason, pattern, field of the event).
THREATS = (
    *(("injection", "critical", "command", p, "command") for p in (r";\s*rm\s+-rf", r"\|\s*bash", r"\|\s*sh", r"`.*`", r"\$\(.*\)", r"&&\s*curl", r";\s*wget", r">\s*/dev/null.*&")),
    *(("injection", "critical", "sql", "(?i)" + p, "command") for p in (r"'\s*OR\s*'1'\s*=\s*'1", r";.*DROP\s+TABLE", r"UNION\s+SELECT", r"'\s*;\s*DELETE\s+FROM")),
    ("injection", "critical", "sql", r"--\s*$", "command"),
    *(("injection", "high", "path", p, "path") for p in (r"\.\./", r"\.\.\\", "(?i)%2e%2e%2f", "(?i)%2e%2e%5c")),
    ("secret_leakage", "critical", "api key", "sk-[a-zA-Z0-9]{20,}", "content"),
    ("secret_leakage", "critical", "map key", "AIza[a-zA-Z0-9_-]{35}", "content"),
    ("secret_leakage", "critical", "mail key", "[a-zA-Z0-9]{32}-us[0-9]{1,2}", "content"),
    ("secret_leakage", "critical", "chat token", "xox[baprs]-[a-zA-Z0-9-]+", "content"),
    ("secret_leakage", "critical", "repository token", "ghp_[a-zA-Z0-9]{36}", "content"),
    ("destructive_operation", "critical", "root deleted", r"rm\s+-rf\s+/", "command"),
    ("destructive_operation", "critical", "fork bomb", r":\(\)\{\s*:\|:&\s*\};:", "command"),
    ("destructive_operation", "critical", "disk overwritten", "dd\\s+if=/dev/zero", "command"),
    ("copy_marker", "high", "U+FFFD", "�", "content"),
    ("copy_marker", "medium", "U+3000", "　", "content"),
)


#: Strings of which a text that fits an intent's pattern holds one of each group, for patterns that are not words in groups.
NEEDED = {
    "SKILL_INVOCATION": (("スキル",), ("使って", "使用して", "利用して", "で")), "EXISTING_FILE_REFERENCE": (("編集", "修正", "変更", "更新"),), "FILE_READ": (("読んで", "確認して", "見て", "表示して"),),
    "CODE_BUGFIX": (("バグ", "エラー", "問題", "不具合"), ("修正", "直して", "fix")), "SKILL_EXECUTE": (("/",),), "QUESTION": (("?",),),
}
_NAMED = {p: n for n, p, _ in INTENTS}
_WORDS = r"\(([^()\[\]\\.*+?^|]+(?:\|[^()\[\]\\.*+?^|]+)*)\)"
_FILE_SIGNS = "[a-zA-Z0-9_\\-./]"
#: Fixed value: the endings of the file pattern, to tell texts without any.
_FILE_END = "(?i)\\.(?:ts|js|md|txt|yml|yaml|css|scss|html)"


def _needed(pattern: str) -> tuple[tuple[str, ...], ...]:
    if m := re.fullmatch(f"{_WORDS}(?:\\.\\*{_WORDS})?", pattern):
        return tuple(tuple(g.split("|")) for g in m.groups() if g)
    return NEEDED.get(_NAMED.get(pattern, ""), ())


def _linear(pattern: str) -> str:
    """A pattern that fits the same texts in a time in proportion to them: from the first of the first words of a line, or from the start of a name, only."""
    words = lambda a, b: f"^(?>.*?(?:{a})).*(?:{b})"
    if m := re.fullmatch(f"{_WORDS}\\.\\*{_WORDS}", pattern):
        return "(?m)" + words(*m.groups())
    if m := re.fullmatch(f"\\({_WORDS}\\.\\*{_WORDS}\\|{_WORDS}\\.\\*{_WORDS}\\)", pattern):
        return f"(?m)(?:{words(m[1], m[2])}|{words(m[3], m[4])})"
    return pattern.replace(f"({_FILE_SIGNS}+", f"((?<!{_FILE_SIGNS}){_FILE_SIGNS}+").replace("([a-z\\-]+)スキル", "((?<![a-z\\-])[a-z\\-]+)スキル")


def fits(text: Column, pattern: str) -> Column:
    """Whether a text fits a pattern of INTENTS; texts without its words are told by these alone."""
    one_of = lambda words: reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])
    return reduce(lambda a, b: a & b, [*map(one_of, _needed(pattern)), text.rlike(_linear(pattern))])


def _said(text: Column, patterns) -> Column:
    """Whether a text fits one of the patterns of DEVIATION or REUSE; words are looked for before patterns are."""
    low = F.lower(text)

    def one(p: str) -> Column:
        source, plain = (low, p[4:]) if p.startswith("(?i)") else (text, p)
        held = reduce(lambda a, b: a & b, [F.contains(source, F.lit(w)) for w in plain.split(".*")])
        return held if plain == p and ".*" not in p else held & text.rlike(p)

    return reduce(lambda a, b: a | b, [one(p) for p in patterns])


def skill_of(text: Column) -> Column:
    """The skill that a request names, by its name or after a slash; null without one."""
    named = F.when(F.contains(text, F.lit("スキル")) | F.contains(F.lower(text), F.lit("skill")), F.regexp_extract(text, SKILL[0], 1))
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(F.regexp_extract(text, SKILL[1], 1), F.lit("")))


def file_paths(text: Column) -> Column:
    """The paths in a request, each once."""
    pattern = ENTITIES[1][1].replace(f"({_FILE_SIGNS}+", f"((?<!{_FILE_SIGNS}){_FILE_SIGNS}+")
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))
    return F.when(~text.rlike(_FILE_END), F.array().cast("array<string>")).otherwise(found)


def context_flags(text: Column, continued: Column, known: Column, baseline: Column) -> dict[str, Column]:
    """What :func:`folioforge.operators.risk.confidence` asks of a request; ``known`` and ``baseline`` are arrays of paths."""
    there = F.array_intersect(file_paths(text), known)
    return {
        "continued": continued, "reuse": _said(text, REUSE), "skill": skill_of(text).isNotNull(), "files": F.size(there) > 0,
        "deviation": _said(text, DEVIATION), "baseline": F.size(F.array_intersect(there, baseline)) > 0,
    }


def entities(text: Column) -> Column:
    """Structs (type, value) of a request's skills, files, numbers and addresses, in order of type and place."""
    of = lambda t, p: F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda v: F.struct(F.lit(t).alias("type"), v.alias("value")))
    return F.concat(*[of(t, p) for t, p in ENTITIES])


FEATURES = (
    "tool_edit", "tool_write", "tool_bash", "tool_read", "tool_skill", "file_exists", "file_baseline", "file_js", "file_ts", "file_md", "continued", "late_night", "recent_errors",
    "confidence", "reuse", "skill", "existing_file", "cmd_rm", "cmd_sudo", "cmd_install", "approval_rate", "error_rate",
)


def features(
    tool: Column, path: Column, command: Column, flags: dict[str, Column], confidence: Column, hour: Column, exists: Column,
    baseline: tuple[str, ...], approval_rate: Column | None = None, error_rate: Column | None = None,
) -> Column:
    """The 22 features of an action, from 0 to 1, in the order of FEATURES; rates are 0.8 and 0.05 where nothing is known."""
    path, command = F.coalesce(path, F.lit("")), F.coalesce(command, F.lit(""))
    ends = lambda *s: reduce(lambda a, b: a | b, [F.endswith(path, F.lit(x)) for x in s])
    word = lambda p: command.rlike(f"(?<![A-Za-z0-9_]){p}(?![A-Za-z0-9_])")
    truth = [tool == t for t in ("Edit", "Write", "Bash", "Read", "Skill")]
    truth += [exists & (path != ""), reduce(lambda a, b: a | b, [F.contains(path, F.lit(b)) for b in baseline]), ends(".js", ".jsx", ".mjs", ".cjs"), ends(".ts", ".tsx"), ends(".md")]
    truth += [flags["continued"], (hour >= 23) | (hour < 5), F.lit(False)]
    more = [flags["reuse"], flags["skill"], flags["files"], word("rm"), word("sudo"), word(r"(?:npm|yarn|pnpm)\s+install")]
    number = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    rate = lambda c, other: F.coalesce(c, F.lit(other)) if c is not None else F.lit(other)
    return F.array(*map(number, truth), F.least(F.lit(1.0), confidence / 100), *map(number, more), rate(approval_rate, 0.8).cast("double"), rate(error_rate, 0.05).cast("double"))


def threats(command: Column, path: Column, content: Column) -> Column:
    """Structs (category, severity, reason) of what an event's command, path and content hold, each once, in fixed order."""
    of = {"command": command, "path": path, "content": content}
    found = [F.when(of[where].rlike(p), F.struct(F.lit(c).alias("category"), F.lit(s).alias("severity"), F.lit(r).alias("reason"))) for c, s, r, p, where in THREATS]
    return F.array_distinct(F.array_compact(F.array(*found)))


#: Sections and endpoints of a page's analysis at most, and characters of its description.
SECTIONS, ENDPOINTS, DESCRIPTION = 20, 10, 200


def page_analysis(url: Column, title: Column, summary: Column, kind: Column) -> dict[str, Column]:
    """Columns of a page: title, description, sections; name and price of a product; endpoints of an interface."""
    path = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    host = F.regexp_extract(url, r"^[a-zA-Z]+://(?:[^@/?#]*@)?([^/?#:]*)", 1)
    heads = F.transform(F.regexp_extract_all(summary, F.lit(r"(?m)^(#+[ \t]+[^\n]+)$"), F.lit(1)), lambda h: F.trim(F.regexp_replace(h, r"^#+[ \t]+", "")))
    price = F.nullif(F.regexp_extract(summary, r"(\$[0-9,]+\.?[0-9]*)", 1), F.lit(""))
    calls = F.regexp_extract_all(summary, F.lit(r"(?i)((?:GET|POST|PUT|DELETE|PATCH)\s+/[A-Za-z0-9_\-/{}]+)"), F.lit(1))
    return {
        "title": F.coalesce(F.nullif(title, F.lit("")), F.lower(host)), "description": F.substring(summary, 1, DESCRIPTION), "sections": F.slice(heads, 1, SECTIONS),
        "product_name": F.when(kind == "product", F.coalesce(F.nullif(title, F.lit("")), F.nullif(F.substring_index(path, "/", -1), F.lit("")))),
        "price": F.when(kind == "product", price), "endpoints": F.when(kind == "api", F.slice(calls, 1, ENDPOINTS)),
    }
