"""Label sets: normal form, category by priority, gaps in a report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All white space, beyond ASCII too.
BLANK = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def normal(labels: Column) -> Column:
    """Trimmed lower-case labels without leading stars; null labels become empty."""
    return F.transform(labels, lambda x: F.ltrim(F.lower(F.btrim(F.coalesce(x, F.lit("")), F.lit(BLANK))), F.lit("*")))


def category(labels: Column, classes: dict[str, str], priority: list[str]) -> Column:
    """The class of highest priority that any label maps to; null if none does."""
    known = F.create_map(*[F.lit(v) for kv in classes.items() for v in kv])
    found = F.transform(normal(labels), lambda x: F.try_element_at(known, x))
    return F.try_element_at(F.filter(F.array(*map(F.lit, priority)), lambda c: F.coalesce(F.array_contains(F.array_compact(found), c), F.lit(False))), F.lit(1))


def gaps(tests: dict[str, Column]) -> Column:
    """Names of the tests that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()]))


#: Logins and labels of the rules, and the rules in the order in which they are tried.
BOTS = ["dependabot[bot]", "renovate[bot]", "github-actions[bot]", "stale[bot]", "codecov[bot]", "greenkeeper[bot]", "mergify[bot]"]
BUG_LABELS = ["bug", "defect", "regression", "type:bug", "type: bug", "kind/bug", "bug report"]
REJECTED_LABELS = ["duplicate", "invalid", "wontfix", "won't fix", "not-a-bug", "not a bug", "cannot reproduce", "cannot-reproduce", "stale", "no-repro", "needs-info", "needs more info"]
QUESTION_LABELS = ["question", "support", "type:support", "type: support", "discussion", "kind/support"]
DROPS = ["drop_no_author", "drop_bot", "drop_locked", "drop_question"]
POSITIVE = ["R1_merged_pr_link", "R1b_merged_pr_textual_reference", "R2_bug_label_completed"]
NEGATIVE = ["R3_non_actionable_label", "R3b_state_not_planned", "R4_default_non_actionable"]
CLOSING = r"(?i)\b(fix(es|ed)?|close[sd]?|resolve[sd]?)\s+#"


def plain(labels: Column) -> Column:
    """Trimmed lower-case labels; null labels become empty."""
    return F.transform(labels, lambda x: F.lower(F.btrim(F.coalesce(x, F.lit("")), F.lit(BLANK))))


def any_of(labels: Column, wanted: list[str]) -> Column:
    """Whether a label is in the list; false for a null array."""
    return F.coalesce(F.arrays_overlap(plain(labels), F.array(*map(F.lit, wanted))), F.lit(False))


def any_contains(labels: Column, part: str) -> Column:
    return F.coalesce(F.exists(labels, lambda x: F.contains(F.lower(F.coalesce(x, F.lit(""))), F.lit(part))), F.lit(False))


def closes(body: Column, number: Column) -> Column:
    """Whether the body says that it closes this number: a closing word, white space, # and the whole number."""
    return F.coalesce(F.regexp_like(body, F.concat(F.lit(CLOSING), number.cast("string"), F.lit(r"\b"))), F.lit(False))


def known_bot(login: Column) -> Column:
    """In the configured list, case as written."""
    return F.coalesce(login.isin(BOTS), F.lit(False))


def is_human(login: Column) -> Column:
    """A login that is neither configured as a bot nor ends like one."""
    return F.coalesce((login != "") & ~login.isin(BOTS) & ~login.endswith("[bot]"), F.lit(False))


def looks_like_bot(login: Column) -> Column:
    return F.coalesce(login.endswith("[bot]") | login.endswith("-bot"), F.lit(False))


def issue_rules(author: Column, locked: Column, labels: Column, state_reason: Column, merged_link: Column, references: Column, number: Column, drop_locked: bool = False) -> list[tuple[str, Column]]:
    """The rules for issues, first match wins; the last one always holds. references: array of struct<merged, body>."""
    no_author = author.isNull() | (author == "")
    conditions = [
        no_author, known_bot(author), F.lit(drop_locked) & F.coalesce(locked, F.lit(False)), any_of(labels, QUESTION_LABELS), merged_link,
        F.exists(references, lambda r: r["merged"] & closes(r["body"], number)), any_of(labels, BUG_LABELS) & F.coalesce(state_reason == "COMPLETED", F.lit(False)),
        any_of(labels, REJECTED_LABELS), state_reason == "NOT_PLANNED", F.lit(True),
    ]
    return list(zip([*DROPS, *POSITIVE, *NEGATIVE], conditions))


def issue_label(rule: Column) -> Column:
    """1, 0, or null where the rule drops the row."""
    return F.when(rule.isin(POSITIVE), 1).when(rule.isin(NEGATIVE), 0)
