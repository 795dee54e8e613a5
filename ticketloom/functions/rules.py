"""Weak urgency labels from a table of rules, and the escalation decision built on them.

A rule is data: name, vote, whether it decides alone, and a pattern. Every rule is one native
expression, so labelling is a single projection without a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.scale import computed_once, dealt_out
from ..schema import MIN_CONFIDENCE, REFUND_THRESHOLD
from .patterns import searchable
from .prefilter import Prefilter
from .sentiment import compound
from .text import count_char, words_of_three

# --- Fixed values: the rule table ----------------------------------------------------------
WEEKDAY = r"(monday|tuesday|wednesday|thursday|friday|saturday|sunday)"
EVENT = (
    r"\b(flight|surgery|operation|exam|wedding|funeral|interview|appointment|trip|move|moving|contractor"
    r"|job|shift|party|ceremony|visa|court|deadline|launch)"
)
SOON = rf"(today|tonight|tomorrow|this (morning|afternoon|evening|weekend)|in the morning|on {WEEKDAY})"
NOT_SHOUTED = ("UPS", "USPS", "DHL", "ETA", "FAQ", "USB", "LED", "BPA", "FEDEX", "PDF", "ORD")
VERY_NEGATIVE, NEGATIVE = -0.75, -0.4

# (name, vote, strong, pattern); rules without a pattern are expressions, see _condition
RULES: tuple[tuple[str, str, bool, str | None], ...] = (
    (
        "time_pressure", "high", True,
        r"\burgent(ly)?\b|\basap\b|\bimmediately\b|\bright (now|away)\b|as soon as possible"
        r"|\bemergency\b|time[- ]sensitive|\bdeadline\b|as a priority|high priority"
        rf"|\bby (today|tonight|tomorrow|this weekend|{WEEKDAY})\b"
        rf"|\bbefore (tomorrow|tonight|the weekend|{WEEKDAY})\b"
        r"|\b(today|tonight)\b.{0,20}\b(or|otherwise)\b"
        r"|\bneed\b.{0,60}\b(today|tonight|tomorrow)\b|\b(tomorrow|tonight) (morning|evening|night)\b"
        r"|\bbefore (my|our|the) \w+ (tomorrow|tonight)\b"
        rf"|{EVENT}\b.{{0,40}}\b{SOON}\b|\b{SOON}\b.{{0,40}}{EVENT}\b",
    ),
    (
        "escalation_threat", "high", True,
        r"charge ?back|\bdispute\b|\bmy bank\b|credit card company|\blawyer|\battorney"
        r"|legal action|\bsue\b|small claims|consumer protection|\bbbb\b|better business bureau"
        r"|(bad|negative|one[- ]star|1[- ]star) review|\breport (you|this)\b|\bfraud|\bscam"
        r"|\b(speak|talk) to (a |your )?(manager|supervisor)|\b(want|need|get) (a |your )?(manager|supervisor)"
        r"|\bescalat(e|ed|ion)\b",
    ),
    (
        "repeat_contact", "high", True,
        r"\b(second|third|fourth|fifth|\d+(st|nd|rd|th)) (\w+ )?(time|email|message|request|wrong|replacement|delay|complaint)"
        r"|\b(emailed|called|contacted|messaged|written|asked|reached out)\b.{0,15}"
        r"\b(twice|again|three times|multiple times|several times|many times)\b"
        r"|\bno (one|body)\b.{0,20}\b(replied|responded|answered|got back|gotten back)"
        r"|\bnobody\b.{0,20}\b(replies|responds|answers|helps)\b"
        r"|still (no|haven't had a|have not had a) (response|reply|answer)|\bignor(ed|ing) (me|my)",
    ),
    (
        "safety", "high", True,
        r"\bfire\b|\bsmok(e|ing)\b|\bspark(s|ing)?\b|\bburn(ed|t|ing)\b|electric(al)? shock"
        r"|\binjur|\bhurt (me|my|him|her|them)|\bdangerous\b|\bhazard|\bmelt(ed|ing)\b|\bchok(e|ing)\b"
        r"|\bmou?ld(y)?\b|\bunsafe\b|\btoxic\b|is (it|this) safe|allergic reaction|\bpoison"
        r"|(warm|hot) to the touch|overheat|\ballerg(en|y|ic)|\bfrayed\b|\brecall(ed)?\b|chemical smell"
        r"|exposed wir|wir(e|es|ing) (is |are )?exposed|(doesn'?t|won'?t|does not|will not) (latch|lock|click|hold)|glass (in|inside)",
    ),
    (
        "hardship", "high", True,
        r"\brent\b|\bbounced\b|overdrawn|can'?t afford|my bills|\bmedication\b|\binsulin\b|prescription"
        r"|\bmedical\b|\bhospital\b|\bdisabled\b|\bnewborn\b|wheelchair|\boxygen\b|hearing aid",
    ),
    (
        "fraud_or_privacy", "high", True,
        r"unauthori[sz]ed|(didn'?t|did not|never) (make|made|place|placed|authori[sz]ed?|order|ordered)\b|with my card"
        r"|(don'?t|do not) recogni[sz]e (this|the|a|that) (charge|payment|order|transaction)"
        r"|\bhacked\b|stolen card|someone (else )?(used|placed|has) (my|an order)"
        r"|(another|other|someone else'?s?) customer'?s? (name|address|details|order)|data breach"
        r"|my (personal )?(details|information|address) (is|are|was|were) (visible|exposed|leaked|shown)",
    ),
    (
        "money_lost", "high", True,
        r"wrong (bank )?account|closed account|money (is |has )?(gone|missing|disappeared|vanished)"
        r"|missing (that|the|my) money|charged but (the )?(order|nothing)|balance (has )?(disappeared|vanished|gone)"
        r"|out of pocket|left my account",
    ),
    ("profanity", "high", True, r"\bf+u+c+k|\bshit|\bdamn|\bgoddamn|\bcrap\b|\bwtf\b|\bbullshit\b|\bhell\b"),
    (
        "strong_anger", "high", False,
        r"unacceptable|ridiculous|outrageous|disgust|\bworst\b|furious|livid|fed up|sick of"
        r"|pathetic|incompetent|\ba joke\b|\bnever (shop|order|buy)\w* (here|from you)"
        r"|hung up on me|how i'?m (being )?treated|\btheft\b|\bstealing\b|disgrace|shambles|\buseless\b|fuming",
    ),
    (
        "patience_lost", "high", False,
        r"\b(absolutely|completely|totally|utterly|beyond) (unacceptable|ridiculous|disgusting|outrageous|a joke)"
        r"|patience (has )?(completely )?(run out|worn thin)|more than patient|done being (patient|polite)"
        r"|at my wits'? end|loyal customer",
    ),
    ("shouting", "high", False, None),
    ("exclamation_burst", "high", False, None),
    ("very_negative", "high", False, None),
    (
        "problem_reported", "medium", False,
        r"\bbroken\b|\bbroke\b|damaged|cracked|shattered|smashed|crushed|dented|scratched|\bbent\b|\btorn\b"
        r"|defective|\bleak(s|ed|ing)?\b|\bruined\b|\bmissing\b"
        r"|\blate\b|\bdelay(s|ed)?\b|overdue|\bstuck\b|\blost\b|never (arrived|came|showed)"
        r"|(haven't|have not|hasn't|has not|didn't|did not|still not) (been )?(received|arrived|delivered|come)"
        r"|\bwrong\b|not working|doesn't work|does not work|won't (turn on|work|pair|connect|charge|lock|close)"
        r"|\bsplit\b|\bsnapped\b|\bcrack(s)?\b|\bchip(ped)?\b|\bscuff(ed)?\b|\bstain(s|ed)?\b|broken off"
        r"|doesn'?t (fit|match)|does not (fit|match)|didn'?t (fit|match)|not as (described|advertised|shown)"
        r"|different (colou?r|shade|size)|than (advertised|described|shown)|can'?t (assemble|use|install)"
        r"|\berror\b|timed out|\b404\b|never received|(nobody|no one) (showed|came|turned up)",
    ),
    (
        "frustration", "medium", False,
        r"frustrat|disappoint|annoy|\bupset\b|unhappy|not happy|\bconcerned\b|worried|confus"
        r"|been waiting|still waiting|waiting (for|on) (my|the|a)",
    ),
    (
        "money_back", "medium", False,
        r"\b(want|need|demand|get|getting|expect|expecting|waiting for|where is) (a |my |the )?"
        r"(full )?(refund|money back|rebate|reimbursement|compensation)"
        r"|charged (me )?twice|double charged|overcharged",
    ),
    (
        "stalled", "medium", False,
        r"(hasn'?t|has not|haven'?t|have not) (been )?(moved|updated|changed|heard|shipped|processed)"
        r"|\bno (update|updates|movement|sign)\b|still (says|shows|showing|pending|processing|in transit)"
        r"|behind (the )?(estimate|schedule)|was (supposed|meant|due|scheduled|estimated) (to|for|on)"
        r"|delivery date (has )?passed|sitting (in|at)|nothing yet|heard nothing|not heard back",
    ),
    (
        "billing_issue", "medium", False,
        r"charged (me )?(full price|twice|the wrong|more|for)|double (billed|charged)|overcharged"
        r"|(promo|discount|coupon) code|(didn'?t|did not|wasn'?t|was not|not) (been )?applied"
        r"|price (dropped|changed)|total was|refunded \$?\d+|partial refund|renewed but",
    ),
    (
        "action_request", "medium", False,
        r"look into|\bchase\b|sort (this|it) out|what happened|what'?s going on|what'?s happening|what'?s holding"
        r"|next steps?|my options|exchange (this|it)|to exchange|process (to|for) return|return (it|this) for",
    ),
    ("negative_sentiment", "medium", False, None),
    (
        "calm_language", "low", False,
        r"no rush|no hurry|not urgent|nothing urgent|non-urgent|not in a hurry|no big deal|not a (big|huge) deal"
        r"|no worries|whenever (you|suits|convenient|possible)|when you (get|have) a (chance|moment|minute)"
        r"|when possible|just curious|out of curiosity|for my records|no issue|just wondering|take your time"
        r"|happy to wait",
    ),
)
CANCELLED_BY_CALM = ("time_pressure", "negative_sentiment", "very_negative")
# --- end of fixed values -------------------------------------------------------------------

RULE_NAMES = tuple(name for name, *_ in RULES)
STRONG = tuple(name for name, vote, strong, _ in RULES if vote == "high" and strong)
WEAK_HIGH = tuple(name for name, vote, strong, _ in RULES if vote == "high" and not strong)
MEDIUM = tuple(name for name, vote, _, _ in RULES if vote == "medium")


def names(values) -> Column:
    return F.array(*map(F.lit, values))


def is_shouting(text: Column) -> Column:
    """Two or more words in capitals that are a third of the words or of which two have 4+ letters."""
    words = words_of_three(text)
    loud = F.filter(words, lambda w: (w == F.upper(w)) & ~w.isin(*NOT_SHOUTED))
    long_loud = F.size(F.filter(loud, lambda w: F.length(w) >= 4))
    return (F.size(loud) >= 2) & ((F.size(loud) / F.size(words) >= 0.3) | (long_loud >= 2))


#: One search tells which patterns can match at all.
LITERALS = Prefilter({name: pattern for name, _, _, pattern in RULES if pattern is not None})


def _condition(name: str, pattern: str | None, text: Column, score: Column, found: Column | None) -> Column:
    if pattern is not None:
        # U: Unicode word boundaries, d: only a newline ends a line
        matches = F.lower(text).rlike(f"(?Ud){searchable(pattern)}")
        return matches if found is None else LITERALS.possible(name, found) & matches
    return {
        "shouting": is_shouting(text),
        "exclamation_burst": F.contains(text, F.lit("!!")) | (count_char(text, "!") >= 3),
        "very_negative": score <= VERY_NEGATIVE,
        "negative_sentiment": (score > VERY_NEGATIVE) & (score <= NEGATIVE),
    }[name]


def fired(text: Column, score: Column, found: Column | None = None) -> Column:
    """Names of the rules that fire on the text, in rule order; `score` is its compound sentiment, `found` its literals
    (`LITERALS.found` of the lower-case text), without which every pattern is tried."""
    return F.array_compact(F.array(*[F.when(_condition(n, p, text, score, found), F.lit(n)) for n, _, _, p in RULES]))


def voting(fired_rules: Column) -> Column:
    """Fired rules that still vote: calm wording cancels the rules hedged wording triggers."""
    calm = F.array_contains(fired_rules, "calm_language")
    return F.when(calm, F.array_except(fired_rules, names(CANCELLED_BY_CALM))).otherwise(fired_rules)


def label(votes: Column) -> Column:
    weak = F.size(F.array_intersect(votes, names(WEAK_HIGH)))
    medium = F.arrays_overlap(votes, names(MEDIUM))
    high = F.arrays_overlap(votes, names(STRONG)) | (weak >= 2) | ((weak >= 1) & medium)
    return F.when(high, "high").when((weak >= 1) | medium, "medium").otherwise("low")


def strong_signals(votes: Column) -> Column:
    return F.array_intersect(votes, names(STRONG))


def with_rules(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds `fired`, `votes`, `weak_label` and `signals`.

    The literals and the fired rules are each computed once a row: later steps and filters refer to the results. The patterns
    take far longer over a text than an exchange of it, so rows are dealt out evenly first: a file of one row group is else one
    task, and so are short texts where Spark cuts the partitions by their bytes.
    """
    searched = computed_once(dealt_out(df), {"__compound": compound(F.col(text)), "__found": LITERALS.found(F.lower(F.col(text)))})
    return (
        computed_once(searched, {"fired": fired(F.col(text), F.col("__compound"), F.col("__found"))})
        .drop("__compound", "__found")
        .withColumn("votes", voting(F.col("fired")))
        .withColumns({"weak_label": label(F.col("votes")), "signals": strong_signals(F.col("votes"))})
    )


def escalation_reasons(
    min_confidence: float = MIN_CONFIDENCE, refund_threshold: float = REFUND_THRESHOLD
) -> Column:
    """Every reason to escalate, in rule order, from the columns urgency, urgency_confidence,
    category, category_confidence, order_amount and signals. Null confidences fire nothing."""
    c = F.col
    two = lambda x: F.when(x.isNotNull(), F.format_string("%.2f", x.cast("double")))
    low = lambda kind: F.when(
        c(f"{kind}_confidence") < min_confidence,
        F.concat(F.lit(f"Low {kind} confidence ("), two(c(f"{kind}_confidence")), F.lit(f" < {min_confidence})")),
    )
    not_high = F.coalesce(c("urgency") != "high", F.lit(True))
    return F.array_compact(
        F.array(
            F.when(
                c("urgency") == "high",
                F.concat(F.lit("Urgency classified high (confidence "), F.coalesce(two(c("urgency_confidence")), F.lit("n/a")), F.lit(")")),
            ),
            low("category"),
            low("urgency"),
            F.when(
                (c("category") == "refund_request") & (c("order_amount") > refund_threshold),
                F.concat(F.lit("Refund request on a $"), two(c("order_amount")), F.lit(f" order (over ${refund_threshold:.0f})")),
            ),
            F.when(
                not_high & (F.size("signals") > 0),
                F.concat(F.lit("Strong urgency signal in the text: "), F.array_join("signals", ", ")),
            ),
        )
    )


def with_decision(df: DataFrame) -> DataFrame:
    """Adds `reasons`, `needs_escalation` and `escalation_reason` (null when nothing fired)."""
    return df.withColumn("reasons", escalation_reasons()).withColumns(
        {
            "needs_escalation": F.size("reasons") > 0,
            "escalation_reason": F.nullif(F.array_join("reasons", "; "), F.lit("")),
        }
    )


# --- auditing ------------------------------------------------------------------------------


def rule_coverage(labelled: DataFrame) -> DataFrame:
    """Share of rows each rule fires on, and the share without any; one pass, one row per task."""
    flags = [F.count_if(F.array_contains("fired", n)).alias(n) for n in RULE_NAMES]
    totals = labelled.agg(F.count("*").alias("rows"), F.count_if(F.size("fired") == 0).alias("none"), *flags)
    cells = [F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in (*RULE_NAMES, "none")]
    return totals.select("rows", F.inline(F.array(*cells))).select(
        "rule", "n", F.try_divide(F.col("n").cast("double"), F.col("rows")).alias("share")
    )


def label_distribution(labelled: DataFrame, column: str = "weak_label") -> DataFrame:
    counts = labelled.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))
    total = labelled.agg(F.count("*").alias("total")).scalar()
    return counts.select("label", "n", (F.col("n").cast("double") / total).alias("share"))


def rule_conflicts(labelled: DataFrame) -> DataFrame:
    """How often each pair of rules fires together (a rule with itself: how often it fires).

    Pairs come from one row's own short list of rule names, at most 21 x 21 for any text.
    """
    distinct = labelled.groupBy("fired").agg(F.count("*").alias("n"))
    return (
        distinct.select("fired", "n", F.explode("fired").alias("rule"))
        .select("n", "rule", F.explode("fired").alias("other"))
        .groupBy("rule", "other")
        .agg(F.sum("n").alias("n"))
    )


def rule_precision(labelled: DataFrame, truth: str) -> DataFrame:
    """Per rule: rows it fires on and the share whose true label equals its vote."""
    votes = F.create_map(*[F.lit(x) for n, v, _, _ in RULES for x in (n, v)])
    return (
        labelled.groupBy("fired", F.col(truth).alias("truth"))
        .agg(F.count("*").alias("n"))
        .select("n", "truth", F.explode("fired").alias("rule"))
        .groupBy("rule")
        .agg(F.sum("n").alias("fires"), F.sum(F.when(F.col("truth") == F.element_at(votes, F.col("rule")), F.col("n")).otherwise(0)).alias("agreed"))
        .select("rule", "fires", "agreed", (F.col("agreed").cast("double") / F.col("fires")).alias("precision"))
    )
