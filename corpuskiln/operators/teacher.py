"""Teacher rows: ordered checks by strictness, with exact and near duplicates among accepted rows in between.

Rows are checked in the order of ``id`` (a number that says where each came from).  The checks before the duplicates
name the first rule that fails; then a row is a duplicate if an earlier accepted row has the same instruction and
output, or, within a category, nearly the same word 5-grams; the checks by category come last, so a row that fails one
of these may be a duplicate, but makes none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..session import stored
from . import dedup
from .rules import first_failure

STRICTNESS = ("strict", "standard", "lenient")
#: Overlap from which the standard tier warns.
SUSPECT = 0.82
LEAST_GRAMS = 4
_CHATTY_EXEMPT = ("identity_chat", "emotional_support_kindness")


def _by_category(table: dict[str, int], category: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), category)


def identity_ok(x: Column, name: str) -> Column:
    low = F.lower(x)
    persona = low.rlike(r"\b(i\b|i'm|i am|my name|my |me |myself)\b") | T.has_cue(x, [name])
    legacy = low.rlike(r"\b(i am|i'm|my name is|i can|i do not|i don't)\b")
    return (persona & T.has_cue(x, [name, *K.HELPER_TERMS])) | legacy


def explanation_ok(x: Column) -> Column:
    first = F.get(T.sentences(x), F.lit(0))
    return F.coalesce(T.has_cue(first, list(K.CAUSAL_CUES)) & ~T.starts_like_story(first), F.lit(False))


def refusal_ok(x: Column) -> Column:
    return F.lower(x).rlike(r"\b(can't|cannot|do not|don't|not safe|should not|shouldn't|cannot help)\b") & T.has_cue(x, list(K.REDIRECT_CUES))


def support_ok(x: Column) -> Column:
    return T.has_cue(x, list(K.WARM_CUES)) & T.has_cue(x, [*K.ACTION_CUES, "okay", "ok"]) & ~T.starts_like_story(x)


def markdown_table(x: Column) -> Column:
    return F.contains(x, F.lit("|")) & x.rlike(r"\|[^\S\r\n]*-{3,}[^\S\r\n]*\|")


def length_failure(category: Column, output: Column, n: Column, strictness: str, name: str) -> Column:
    """too_long, too_short or null, for ``n`` words."""
    limits = K.WORD_LIMITS[strictness]
    least, most = (_by_category({c: v[i] for c, v in limits.items()}, category) for i in (0, 1))
    spared = (category == "simple_list") & T.is_list(output) & (T.list_items(output) >= 2)
    if strictness != "strict":
        spared |= (category == "summarization_rewrite") & (n >= 5)
    if strictness == "lenient":
        spared |= (category == "identity_chat") & (n >= 6) & identity_ok(output, name)
    return F.when(n > most, "too_long").when((n < least) & ~spared, "too_short")


def early_failure(row: dict[str, Column], words: Column, strictness: str, name: str, common: Column | None = None) -> Column:
    """The first rule before the duplicates that fails; ``row`` has keys, metadata_is_object, category and the text fields.

    ``common`` is what ``common_failure`` gave, where it is known.
    """
    output, category = T.strip(F.coalesce(row["output"], F.lit(""))), F.coalesce(row["category"], F.lit(""))
    found = common_failure(row, words) if common is None else common
    return F.coalesce(found, length_failure(category, output, F.size(words), strictness, name))


def common_failure(row: dict[str, Column], words: Column) -> Column:
    """The first rule that fails of those that are the same in all tiers."""
    missing = F.size(F.array_except(F.array(*map(F.lit, K.TEACHER_FIELDS)), F.coalesce(row["keys"], F.array().cast("array<string>")))) > 0
    instruction, output = T.strip(F.coalesce(row["instruction"], F.lit(""))), T.strip(F.coalesce(row["output"], F.lit("")))
    category = F.coalesce(row["category"], F.lit(""))
    known = category.isin(*K.TASK_OF_CATEGORY)
    whole = F.concat_ws(" ", instruction, F.coalesce(row["input"], F.lit("")), output)
    rules = [
        (missing, "missing_fields"),
        (F.coalesce(row["language"] != "en", F.lit(True)), "invalid_language"),
        (~F.coalesce(row["metadata_is_object"], F.lit(False)), "invalid_metadata"),
        (~known, "invalid_category"),
        (F.coalesce(row["task_type"] != _by_category(K.TASK_OF_CATEGORY, category), F.lit(True)), "invalid_task_type"),
        (instruction == "", "empty_instruction"),
        (output == "", "empty_output"),
        (T.as_an_ai(output), "as_ai_phrase"),
        (~category.isin(*_CHATTY_EXEMPT) & T.chatty_opener(output), "chatty_opener"),
        (T.blocked_term(whole), "blocked_domain_term"),
        (T.has_url(output) | T.has_url(instruction), "url"),
        (markdown_table(output), "markdown_table"),
        (T.repeated_sentence(output, 3), "repeated_sentence"),
        (T.teacher_loop(words), "obvious_loop"),
        (T.weird_nonword(output), "weird_nonword"),
    ]
    return first_failure(rules)


def late_checks(row: dict[str, Column], strictness: str, name: str) -> tuple[Column, Column]:
    """(the category's rule that fails, or null; the warning that takes its place where the tier is lenient, or null)."""
    category, output = row["category"], T.strip(F.coalesce(row["output"], F.lit("")))
    about = lambda *names: category.isin(*names)
    weak = F.coalesce(
        F.when(about("simple_explanation") & ~explanation_ok(output), "weak_explanation"),
        F.when(about("emotional_support_kindness") & ~support_ok(output), "weak_support"),
        F.when(about("simple_reasoning") & ~T.has_cue(output, list(K.REASONING_CUES)), "weak_reasoning"),
    )
    # an explanation without any sentence stays a failure
    bare = about("simple_explanation") & (F.size(T.sentences(output)) == 0)
    failed = first_failure(
        [
            (about("identity_chat", "simple_explanation", "simple_list", "simple_reasoning", "simple_qa") & T.starts_like_story(output), "story_collapse"),
            (about("identity_chat") & ~identity_ok(output, name), "identity_fail"),
            (about("simple_list") & ~T.is_list(output), "list_format_fail"),
            (about("story_continuation", "summarization_rewrite") & (T.strip(F.coalesce(row["input"], F.lit(""))) == ""), "missing_input"),
            (about("safety_refusal") & ~refusal_ok(output), "unsafe_refusal"),
        ]
    )
    if strictness == "lenient":
        return F.coalesce(failed, F.when(bare, weak)), F.when(failed.isNull() & ~bare, weak)
    return F.coalesce(failed, weak), F.lit(None).cast("string")


def validate(rows: DataFrame, strictness: str = "standard", name: str = "helper", within: str | None = None) -> DataFrame:
    """id, reason (null: accepted) and warnings of teacher rows.

    ``rows`` has id (a number: the order), keys (of the row's JSON object), metadata_is_object, category and the text
    fields, all as columns; ``name`` is the helper's own name; ``within`` names a column, such as the shard, across which
    rows are no duplicates of each other.
    """
    if strictness not in STRICTNESS:
        raise ValueError(f"strictness must be one of {STRICTNESS}")
    fields = ("keys", "metadata_is_object", "category", "task_type", "instruction", "input", "output", "language")
    row = {f: F.col(f) for f in fields}
    scope = F.coalesce(F.col(within).cast("string"), F.lit("")) if within else F.lit("")
    late, weak = late_checks(row, strictness, name)
    worded = rows.select("id", *fields, scope.alias("scope"), T.words(T.strip(F.coalesce("output", F.lit("")))).alias("words"))
    key = F.concat_ws("\n", "scope", T.pair_hash(F.coalesce("instruction", F.lit("")), F.coalesce("output", F.lit(""))))
    judged = worded.withColumn("early", early_failure(row, F.col("words"), strictness, name))
    sound = lambda c: F.when(F.col("early").isNull(), c)  # noqa: E731  only rows that come so far need keys and words
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    checked = stored(judged.select("id", "early", late.alias("late"), weak.alias("weak"), sound(key).alias("pair"), F.concat_ws("\n", "scope", "category").alias("within"), sound(hashes).alias("hashes")))
    reached = checked.where("early IS NULL")
    story, other = K.NEAR_THRESHOLDS[strictness]
    least = F.when(F.substring_index("within", "\n", -1).isin("story_request", "story_continuation"), story).otherwise(other)
    # only a row with so many grams looks for near duplicates
    groups, near = dedup.gram_groups(reached.select("id", "within", F.col("hashes").alias("grams")), F.col("size") >= LEAST_GRAMS, min(SUSPECT, story, other), 5)
    near = stored(near.withColumn("close", F.col("jaccard") >= least))
    keyed = reached.select("id", F.col("late").isNotNull().alias("blocked"), "pair").join(groups, "id")
    strong = near.where("close") if strictness != "lenient" else near.where(F.lit(False))
    settled = dedup.greedy(keyed, ["pair"], "node", strong.select("g", "h"))
    # the largest overlap with an earlier accepted row, for warnings
    accepted = settled.where("state = 'accepted'").select("id").join(groups, "id").groupBy(F.col("node").alias("h")).agg(F.min("id").alias("first"))
    seen = near.join(accepted, "h").select(F.col("g").alias("node"), "first", "jaccard", "close")
    overlaps = groups.join(seen, "node").where(F.col("first") < F.col("id")).groupBy("id").agg(F.max("jaccard").alias("overlap"), F.max("close").alias("close"))
    out = checked.select("id", "early", "late", "weak").join(settled, "id", "left").join(overlaps, "id", "left")
    shown = F.format_number(F.col("overlap"), 2)
    warning = F.lit(None).cast("string")
    if strictness == "lenient":
        warning = F.when(F.col("close"), F.concat(F.lit("near_duplicate_output:"), shown))
    elif strictness == "standard":
        warning = F.when(~F.col("close") & (F.col("overlap") >= SUSPECT), F.concat(F.lit("suspected_near_duplicate:"), shown))
    duplicate = F.when(F.col("state") == "duplicate", F.when(F.col("hit_pair"), "duplicate_instruction_output").otherwise("near_duplicate_output"))
    reason = F.coalesce("early", duplicate, "late")
    warnings = F.when((F.col("early").isNotNull()) | (F.col("state") == "duplicate"), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(warning, "weak")))
    return out.select("id", reason.alias("reason"), warnings.alias("warnings"))
