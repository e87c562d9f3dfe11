"""Fixed values and tunable defaults of the engine.

Word lists, sizes, timeouts and thresholds in this module are data: results
depend on them being exactly as they are.  Logic lives elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------- classes
SMALL, MEDIUM, LARGE = "small", "medium", "large"
LABELS = (SMALL, MEDIUM, LARGE)  # position = numeric label id

# ---------------------------------------------------------------- sources
CHAT_SOURCE = "wildchat"
MATH_SOURCE = "gsm8k"
GOLD_SOURCE = "supralabs"

# ---------------------------------------------------------------- text
# Characters Python's str.split() and str.strip() treat as whitespace.
WHITESPACE_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


# ---------------------------------------------------------------- labeller lexicons
@dataclass(frozen=True)
class Lexicon:
    """Word lists and switches of one heuristic labeller."""

    name: str
    reasoning: tuple[str, ...]
    symbols: tuple[str, ...]
    math_words: tuple[str, ...]
    code: tuple[str, ...]
    simple: tuple[str, ...]
    simple_max_chars: int | None  # exclusive bound on prompt length, None = no bound
    many_questions: int | None  # question count that makes a chat prompt large, None = unused
    math_reads_reasoning: bool  # a math prompt with a reasoning cue is never medium
    indented_code: bool  # an indented block counts as a code block


# Main labeller.
MAIN = Lexicon(
    name="main",
    reasoning=(
        "step by step", "explain why", "prove that", "demonstrate", "calculate", "solve for",
        "derive", "show that", "reason about", "think through", "work through", "justify",
        "analyze", "evaluate", "compare and contrast", "let's think", "chain of thought",
        "reasoning",
    ),
    symbols=(
        "=", "+", "-", "*", "/", "^", "√", "∫", "∑", "∏", ">", "<", "≥", "≤", "≠", "≈", "∞", "π",
        "\\frac", "\\int", "\\sum", "\\prod", "\\sqrt",
    ),
    math_words=(
        "equation", "formula", "theorem", "proof", "calculate", "compute", "integral",
        "derivative", "matrix", "vector", "probability", "statistics", "algebra", "geometry",
        "trigonometry", "calculus", "logarithm",
    ),
    code=(
        "def ", "class ", "import ", "function", "return", "for ", "while ", "if ", "else:",
        "try:", "except:", "```", "python", "javascript", "java", "c++", "algorithm",
        "implement", "debug", "code",
    ),
    simple=(
        "what is", "who is", "when was", "where is", "define", "meaning of", "translate", "list",
        "name", "tell me about",
    ),
    simple_max_chars=100,
    many_questions=3,
    math_reads_reasoning=True,
    indented_code=True,
)

# First reduced labeller.
VARIANT_A = Lexicon(
    name="variant_a",
    reasoning=(
        "step by step", "explain why", "prove that", "calculate", "solve for", "derive",
        "analyze", "evaluate",
    ),
    symbols=("=", "+", "-", "*", "/", "^", "√", "∫", "∑", "\\frac", "\\int"),
    math_words=(),
    code=(
        "def ", "class ", "import ", "function", "return", "```", "python", "algorithm",
        "implement",
    ),
    simple=("what is", "who is", "when was", "define", "meaning of"),
    simple_max_chars=None,
    many_questions=None,
    math_reads_reasoning=False,
    indented_code=False,
)

# Second reduced labeller.
VARIANT_B = Lexicon(
    name="variant_b",
    reasoning=("step by step", "explain why", "prove", "calculate", "solve", "analyze"),
    symbols=("=", "+", "-", "*", "/", "^", "√", "∫", "∑", "\\frac", "\\int"),
    math_words=(),
    code=("def ", "class ", "import ", "```", "python", "function"),
    simple=("what is", "who is", "when was", "define"),
    simple_max_chars=None,
    many_questions=None,
    math_reads_reasoning=False,
    indented_code=False,
)

# ---------------------------------------------------------------- rule layer word lists
# Word lists of the rule layer.
PROOF_WORDS = (
    "prove", "proof", "theorem", "lemma", "corollary", "contradiction", "induction",
    "mathematical proof", "rigorous proof", "formal proof", "qed",
)
DEPTH_WORDS = (
    "explain in detail", "comprehensive", "thorough analysis", "step by step",
    "detailed explanation", "in-depth", "complex", "advanced", "sophisticated", "nuanced",
    "implications", "analyze", "evaluate",
)
STEP_WORDS = (
    "first", "then", "next", "finally", "step 1", "step 2", "multiple", "several", "various",
    "different aspects",
)
CODE_WORDS = (
    "function", "class", "algorithm", "implement", "code", "program", "application", "system",
    "create",
)
REQUIREMENT_WORDS = (
    "with", "including", "that", "using", "should", "must", "comprehensive", "complete",
)
TECHNICAL_WORDS = (
    "authentication", "database", "api", "frontend", "backend", "error handling", "logging",
    "testing", "tests", "validation", "documentation", "deployment",
)
ACADEMIC_WORDS = (
    "research", "analyze", "compare and contrast", "evaluate", "critique", "synthesis",
    "literature review", "hypothesis",
)
SIMPLE_STARTS = ("what is ", "define ", "translate ", "what are ", "who is ", "when was ")

OVERRIDE_CONFIDENCE_CAP = 0.85
# Word counts above which a prompt is raised by its length alone: small to medium, small to large, any to large.
LONG_FOR_SMALL, VERY_LONG_FOR_SMALL, LONG_FOR_ANY = 80, 100, 120
LONG_TOKENS = 300  # estimated tokens above which the labellers call a prompt large

# ---------------------------------------------------------------- model registry and tiers
# Model id, display name, size in GB, timeout in seconds.
MODELS = (
    ("gemma3:4b", "Gemma 3 (4B)", 3.3, 120),
    ("deepseek-r1:1.5b", "DeepSeek R1 (1.5B)", 1.1, 45),
    ("qwen2.5:3b", "Qwen 2.5 (3B)", 1.9, 60),
    ("qwen2.5:7b", "Qwen 2.5 (7B)", 4.7, 180),
    ("zephyr:latest", "Zephyr", 4.1, 150),
    ("deepseek-coder:1.3b", "DeepSeek Coder (1.3B)", 0.776, 40),
    ("qwen2:1.5b", "Qwen 2 (1.5B)", 0.934, 45),
    ("tinyllama:latest", "TinyLlama", 0.637, 30),
    ("qwen2:latest", "Qwen 2", 4.4, 150),
    ("phi3:latest", "Phi-3", 2.2, 60),
    ("qwen2.5-coder:latest", "Qwen 2.5 Coder", 4.7, 180),
)
# Class, models to try first, models to fall back to; order counts.
TIERS = (
    (SMALL, ("tinyllama:latest", "deepseek-coder:1.3b", "qwen2:1.5b"), ("deepseek-r1:1.5b",)),
    (MEDIUM, ("qwen2.5:3b", "phi3:latest"), ("gemma3:4b",)),
    (LARGE, ("qwen2.5:7b", "gemma3:4b"), ("qwen2:latest", "zephyr:latest")),
)
DEFAULT_TIER = MEDIUM
SMALLEST_MODEL = "tinyllama:latest"
BASELINE_MODEL = "qwen2.5:7b"
BASELINE_SIZE_GB = 4.7
DEFAULT_TIMEOUT_S = 120
MAX_FAN_OUT = 3

# Strategy name -> model for every class (None = follow the tiers).
STRATEGIES = {"smart": None, "always_small": SMALLEST_MODEL, "always_large": BASELINE_MODEL}

# ---------------------------------------------------------------- energy
ENERGY_PER_GB_KWH = 5e-5
CO2_KG_PER_KWH = 0.475
BASELINE_KWH = BASELINE_SIZE_GB * ENERGY_PER_GB_KWH

# ---------------------------------------------------------------- sampling
SEED = 42
IMBALANCE_RATIO = 3.0
BALANCE_FACTOR = 2.5
JUDGE_SAMPLE_SIZE = 800
JUDGE_PROMPT_CHARS = 1000
VALIDATION_FRACTION = 0.2

# ---------------------------------------------------------------- response errors
# Error texts of failed requests.
ERROR_TIMEOUT = "Request timeout"
ERROR_UNBOUNDED = "Timeout above the longest of the registry"
ERROR_FORMAT = "Model did not provide confidence score in expected format"
MIN_RESPONSE_CHARS = 10
