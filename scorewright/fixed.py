"""Texts, word lists and patterns that results depend on.

Everything here must stay exactly as it is, misspellings included, because
prompts, extracted answers and labels are compared by value.
"""

from string import ascii_uppercase

# --- instructions and prompt texts -------------------------------------------------
INSTRUCTION = "Let's think step by step and output the final answer after \"The answer is:\"."
SYSTEM_PROMPT = "You are a helpful assistant that can answer questions and help with tasks."
GSM8K_INSTRUCTION = (
    "Solve the following math word problem step by step. "
    "Think carefully and break down the problem. "
    "Make sure to include the final numerical answer after 'The answer is:'"
)
MATH_INSTRUCTION = (
    "Solve the following math problem step by step. "
    "Think step-by-step to reach the solution. "
    "Present the final numerical or symbolic answer enclosed in \\boxed{}. "
    "The final answer should be the only thing within the \\boxed{}."
)
KEYED_OPTIONS_LINE = "Choose the correct option from the following options: \n"
LETTER_SUFFIX = (
    "Choose the correct option from the following options "
    "(for final answer, please only output the letter choice): "
)
ENDING_LINE = "Choose the most appropriate ending for the above text:\n"
CONTEXT_SUFFIX = (
    "Based on the givencontext, choose the correct option for the question from the "
    "following options (for final answer, please only output the letter choice): "
)
MISSING_QUESTION = "[Question text not found or empty]"
MISSING_PROBLEM = "[Problem text not found or empty]"

# --- labels -------------------------------------------------------------------------
LABEL_OUT_OF_BOUNDS = "ERROR_LABEL_OUT_OF_BOUNDS"
LABEL_MISSING = "ERROR_MISSING_LABEL"
LABEL_INVALID = "ERROR_INVALID_LABEL"
UNKNOWN_SUBSET = "unknown"

# --- choice families, in the order they are tried -----------------------------------
CHOICE_FAMILIES = (
    tuple(f"({letter})" for letter in ascii_uppercase[:17]),
    ("A", "B", "C", "D", "E", "F"),
    ("True", "False"),
    ("Yes", "No"),
    ("yes", "no"),
)
TOP_LOGPROBS = 20

# --- answer markers, the longer first ------------------------------------------------
ANSWER_MARKERS = ("answer is:", "answer:")
ANSWER_STRIP = "\n ."
EXACT_STRIP = ". "
MATH_ANSWER_STRIP = " $"
MATH_LINE_STRIP = " .$"
MATH_COMPARE_STRIP = " .,$"

# --- number patterns ------------------------------------------------------------------
# SPACE is Python's Unicode white space as an explicit class, so that Python, Java and RE2
# agree on it; \p{Nd} likewise stands for any decimal digit. Java looks single Latin
# characters up in a bit set, so those are not written as ranges.
SPACE_CHARACTERS = (
    r"\x{9}\x{a}\x{b}\x{c}\x{d}\x{1c}\x{1d}\x{1e}\x{1f}\x{20}\x{85}\x{a0}"
    r"\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACE = f"[{SPACE_CHARACTERS}]"
# Letters beyond ASCII that stand for an ASCII letter when case is ignored.
CASE_PARTNERS = {"i": "\u0130\u0131", "k": "\u212a", "s": "\u017f"}
FLOAT_NUMBER = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"
GROUPED_NUMBER = r"[-+]?(?:\p{Nd}{1,3}(?:,\p{Nd}{3})*(?:\.\p{Nd}+)?|[-+]?\p{Nd}+(?:\.\p{Nd}+)?)"
DOLLAR_NUMBER = r"[-+]?[0-9]*\.?[0-9]+"
NUMERIC_TOLERANCE = 1e-6

# --- benchmark names --------------------------------------------------------------------
SYNTHETIC_SUFFIX = "bbh_syn_all.json"
CHAT_MODEL_WORDS = ("chat", "instruct")
