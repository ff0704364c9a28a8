"""Word lists and small dimension tables.

Everything in the block marked FIXED VALUES must equal the values the
screening, topic and roll-up results were published with; they are stated
plainly, in their natural order, and must not be edited.
"""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

_HERE = Path(__file__).resolve().parent

# ---------------------------------------------------------------- FIXED VALUES
# Keyword stems for pre-screening (a word matches when it starts with a stem).
KEYWORD_STEMS = [
    "hallucinat", "misinform", "disinform", "bias", "discrimin",
    "stereotyp", "inequit", "copyright", "infring",
    "manipulat", "propagand", "privac", "surveil",
    "automat", "labor", "opac", "transparen", "interpret", "explain",
    "account", "trust", "jailbreak", "guardrail", "inject",
    "secur", "saf", "sustain", "ethic", "govern", "regulat",
    "risk", "fair", "harm", "unsaf", "respons", "autonom", "dignit", "justic",
]

# Domain stop words added to the English lists for topic terms.
CUSTOM_STOPWORDS = [
    "chatgpt", "ai", "gpt", "chat", "openai", "google", "microsoft", "bing", "bard", "midjourney",
    "twitter", "blockchain", "bitcoin", "btc", "eth", "nft", "ml", "seo", "amp", "gt",
    "openaichatgpt", "app", "bot", "good", "way", "better", "interesting",
    "thank", "thanks", "amazing", "fun", "lol", "maybe", "thoughts", "thinking",
    "pretty", "wrong", "cool", "bad", "feel", "important", "short", "big",
    "sure", "high", "just", "called", "end", "far", "stuff", "looks", "thought",
    "today", "going", "ve", "let", "want", "day", "got", "try", "ll", "thing",
    "years", "week", "lot", "soon", "coming", "come", "ways", "year", "getting",
    "tried", "vs", "tweet", "days", "trying", "having", "makes", "isn", "won",
    "needs", "months", "yes", "taking", "month", "little", "instead", "hours",
    "mean", "billion", "add", "hey", "million", "pm", "gonna", "comes", "probably",
    "set", "s", "br", "wa", "don", "ha", "doe", "m", "didn", "doesn", "wan", "na",
]

# Category code -> name for the topic roll-up.
CATEGORY_NAMES = {
    1: "Technical safety",
    2: "Privacy and data misuse",
    3: "Fairness and discrimination",
    4: "Malicious misuse",
    5: "Societal and democratic risks",
}

# Placeholder replaced by the text in every prompt template.
PROMPT_SLOT = "{tweet}"
# ------------------------------------------------------------ end FIXED VALUES

# Offline test lexicon: hits rows in the driver's `documents` table, where the
# stems above hit almost none. Used as the rule scorer and as a predictor.
TEST_LEXICON = ["trash", "idiot", "clown", "moron", "worthless", "stupid", "pathetic"]


@lru_cache(maxsize=None)
def english_stopwords() -> tuple[str, ...]:
    """Public English stop-word lists (the classic IR list plus the common
    additions of tagger-based tool kits), one word per line in a data file."""
    words = (_HERE / "stopwords_en.txt").read_text(encoding="utf-8").split()
    return tuple(dict.fromkeys(w.strip().lower() for w in words if w.strip()))


@lru_cache(maxsize=None)
def topic_stopwords() -> tuple[str, ...]:
    """Union used by the topic analytics: English lists and the custom words."""
    return tuple(sorted(set(english_stopwords()) | {w.lower() for w in CUSTOM_STOPWORDS}))


@lru_cache(maxsize=None)
def lemma_pairs() -> tuple[tuple[str, str], ...]:
    """(form, lemma) pairs for the dictionary lemmatiser; identity when absent."""
    out = []
    for line in (_HERE / "lemmas_en.tsv").read_text(encoding="utf-8").splitlines():
        line = line.strip()
        if line and not line.startswith("#"):
            form, lemma = line.split("\t")
            out.append((form, lemma))
    return tuple(out)


@lru_cache(maxsize=None)
def prompt_templates() -> tuple[tuple[str, str], ...]:
    """(name, template) for the four prompt files, primary first."""
    names = ["primary_prompt", "variant_a_minimal", "variant_b_paraphrased", "variant_c_reordered"]
    return tuple((n, (_HERE / "prompts" / f"{n}.txt").read_text(encoding="utf-8")) for n in names)
