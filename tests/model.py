"""Labels and rules restated as plain Python over one prompt, to compare the columns with."""

import re

from promptroute import settings as st


def rules(prompt, predicted, probs):
    low, words = prompt.lower(), len(prompt.split())
    n = lambda ws: sum(w in low for w in ws)
    out = [None] * 6
    small, medium, large = (predicted == c for c in ("small", "medium", "large"))
    if n(st.PROOF_WORDS):
        out[0] = "large" if small or (medium and words > 20) else None
    if words > 120:
        out[1] = None if large else "large"
    elif words > 100 and small:
        out[1] = "large"
    elif words > 80 and small:
        out[1] = "medium"
    if small and n(st.DEPTH_WORDS) >= 2 or medium and n(st.DEPTH_WORDS) >= 3:
        out[2] = "large"
    if n(st.STEP_WORDS) >= 3 and small and words > 30 and probs.get("medium", 0) > 0.1:
        out[3] = "medium"
    code, need, tech = n(st.CODE_WORDS), n(st.REQUIREMENT_WORDS), n(st.TECHNICAL_WORDS)
    if code and tech >= 5:
        out[4] = None if large else "large"
    elif code and need >= 3 and words > 20:
        out[4] = "large" if small or (medium and need >= 5) else None
    elif code and need >= 2 and words > 15:
        out[4] = "medium" if small else None
    if n(st.ACADEMIC_WORDS) and words > 20 and small:
        out[5] = "medium"
    final = next((r for r in reversed(out) if r), predicted)
    return final, [i + 1 for i, r in enumerate(out) if r]


def label(prompt, source, lex):
    low, tokens = prompt.lower(), len(prompt) // 4
    has = lambda text, ws: any(w in text for w in ws)
    reasoning = has(low, lex.reasoning)
    if source == "gsm8k":
        return "medium" if tokens < 40 and not (lex.math_reads_reasoning and reasoning) else "large"
    math = has(prompt, lex.symbols) or has(low, lex.math_words)
    code = has(low, lex.code)
    block = "```" in prompt or (lex.indented_code and bool(re.search(r"\n\s{4,}", prompt)))
    simple = has(low[:50], lex.simple) and (
        lex.simple_max_chars is None or len(prompt) < lex.simple_max_chars
    )
    many = lex.many_questions is not None and prompt.count("?") >= lex.many_questions
    if simple and tokens < 50:
        return "small"
    if tokens < 30 and not (reasoning or math or code or block):
        return "small"
    if reasoning or math or block or tokens > 300 or many:
        return "large"
    return "medium"
