"""Prompts, definitions, phrases, patterns and limits that results must agree with."""

DIMENSIONS = ("coherence", "consistency", "fluency", "relevance")
SCORE_MIN, SCORE_MAX = 1, 5
EXPECTED_DOCS, EXPECTED_MODELS = 100, 16

DEFINITIONS = {
    "coherence": "Coherence measures whether the summary is well-structured and organized, building from sentence to sentence into a coherent body of information.",
    "consistency": "Consistency measures whether the facts in the summary are consistent with the facts in the article, with no contradictions or fabrications.",
    "fluency": "Fluency measures the quality of individual sentences: are they grammatical, well-formed, and easy to read.",
    "relevance": "Relevance measures whether the summary includes only important information from the article, without redundant or irrelevant content.",
}

POINTWISE_PROMPT = """You are evaluating ONLY the {dimension} of a summary. Ignore all other qualities.

{definition}

Important: focus exclusively on {dimension} as defined above. A summary can be excellent in other respects (e.g. well-written, factually accurate) but still score low specifically on {dimension}, and vice versa. Do not let your impression of the summary's other qualities affect this score.

Article:
{article}

Summary:
{summary}

Rate ONLY the {dimension} of this summary on a scale of 1 to 5, where 1 is very poor and 5 is excellent. Respond with ONLY the integer score, nothing else."""

PAIRWISE_PROMPT = """You are comparing two summaries of the same article on {dimension} ONLY. Ignore all other qualities.

{definition}

Article:
{article}

Summary A:
{summary_a}

Summary B:
{summary_b}

Which summary is better on {dimension}? Respond with ONLY "A", "B", or "Tie" if they are equal quality on {dimension}. Do not explain your answer."""

REASONED_PROMPT = """You are comparing two summaries of the same article on {dimension} ONLY. Ignore all other qualities.

{definition}

Article:
{article}

Summary A:
{summary_a}

Summary B:
{summary_b}

First, in 1-2 sentences each, briefly analyze Summary A's {dimension} and Summary B's {dimension}, citing specific evidence from the article or summaries. Then, on its own final line, give your verdict in EXACTLY this format (nothing else on that line):

VERDICT: A
(or VERDICT: B, or VERDICT: Tie)"""

OPENING_FILLERS = (
    "It is important to note that",
    "As the article clearly indicates,",
    "In summary, it can be observed that",
    "Notably, and as one might expect,",
)
CLOSING_HEDGES = (
    "This appears to be the case based on the available information.",
    "That said, further context could add nuance to this point.",
    "Overall, this reflects the key takeaway from the source material.",
)
RESTATEMENT_LEAD = "To put it another way,"

#: Thresholds.
POSITION_BIAS_THRESHOLD = 0.2
MIN_PEARSON_R, MAX_P_VALUE = 0.3, 0.05
THROUGHPUT_BUCKETS = 20
LATENCY_PERCENTILES = (50, 90, 95, 99)

#: Notes and reasons of results.
CONSISTENT_NOTE = "consistent: preferred '{first}' regardless of position"
INCONSISTENT_NOTE = "POSITION BIAS DETECTED: preferred '{first}' when shown first, '{second}' when shown second"
UNPARSED_NOTE = "one or both verdicts failed to parse; cannot assess consistency"
BIASED_REASON = "position-inconsistency {rate} exceeds threshold {threshold}; pairwise verdicts on this dimension are not reliable without order-debiasing (e.g. majority vote across both orders)"
UNBIASED_REASON = "position-inconsistency {rate} is within threshold {threshold}; pairwise verdicts are usable as-is"
AGREED_NOTE = "orders agreed on '{winner}'"
DISAGREED_NOTE = "orders disagreed; no tie-break"
INCONCLUSIVE_NOTE = "one or both verdicts failed to parse; inconclusive"
TIE_BREAK_NOTE = "orders disagreed ({first} vs {second}); random tie-break ({order} order): '{winner}'{unanimous}"
UNANIMOUS = " (unanimous)"
INSIGNIFICANT_REASON = "not statistically significant (p={p} >= {limit})"
WEAK_REASON = "correlation too weak (|r|={r} < {limit})"
TRUSTED_REASON = "significant (p={p}) and sufficiently strong (r={r})"

# What the answer parsers say about how they read an answer.
BARE_NOTE = "bare integer"
OUT_OF_NOTE = "extracted from 'X out of 5' / 'X/5' pattern"
SINGLE_NOTE = "single valid number embedded in text"
AMBIGUOUS_NOTE = ("ambiguous: found ", " candidate numbers ")
OUTSIDE_NOTE = ("found number(s) ", " but none in valid range [1,5]")
NO_NUMBER_NOTE = "no number found in response"
TOKEN_NOTE = "bare token"
TIE_NOTE = "'tie' keyword found"
LEADING_NOTE = "leading letter token"
ONLY_NOTE = {"A": "only Summary A mentioned", "B": "only Summary B mentioned"}
NO_WINNER_NOTE = "could not determine winner from response"
MARKER_NOTE = "found 'VERDICT:' marker"
FALLBACK_NOTE = "no VERDICT marker found; fallback parse: "
