"""Benchmark rows rendered to text. A renderer takes column names and gives SQL text."""

from string import Formatter

# The text formats of the benchmarks.
TEMPLATES = {
    "mmlu": "Subject: {subject}\nQuestion: {question}\n{choices}\nAnswer: {answer}",
    "gsm8k": "Math Problem: {question}\n\nSolution: {answer}",
    "gpqa": "Problem:\n{problem}\n\nSolution:\n{solution}",
    "arc_challenge": "Question: {question}\n{choices}\nAnswer: {answer}",
    "arc_easy": "Question: {question}\n{choices}\nAnswer: {answer}",
    "hellaswag": "Context: {context}\n\nChoose the most plausible continuation:\n{endings}\nAnswer: {answer}",
    "piqa": "Goal: {goal}\n\nWhich solution is better?\nA. {sol1}\nB. {sol2}\nAnswer: {answer}",
    "truthfulqa": "Question: {question}\n\nBest Answer: {best_answer}\n\nCorrect Answers:\n{correct_answers}",
}


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def fill(template: str, **values: str) -> str:
    """A format string with SQL values in its slots; a missing value reads "None"."""
    parts = []
    for text, slot, _, _ in Formatter().parse(template):
        if text:
            parts.append(quoted(text))
        if slot:
            parts.append(f"coalesce(cast({values[slot]} AS string), 'None')")
    return f"concat({', '.join(parts)})"


def letter(position: str) -> str:
    return f"char({position} + {ord('A')})"


def lettered(options: str) -> str:
    return f"array_join(transform({options}, (option, i) -> concat({letter('i')}, '. ', option)), '\\n')"


def labelled(choices: str) -> str:
    pairs = f"zip_with({choices}.label, {choices}.text, (label, text) -> concat(label, '. ', text))"
    return f"array_join({pairs}, '\\n')"


def bulleted(options: str) -> str:
    return f"array_join(transform({options}, option -> concat('- ', option)), '\\n')"


def mmlu(data: str, subject: str) -> str:
    return fill(
        TEMPLATES["mmlu"],
        subject=subject,
        question=f"{data}.question",
        choices=lettered(f"{data}.choices"),
        answer=letter(f"{data}.answer"),
    )


def gsm8k(data: str, subject: str) -> str:
    return fill(TEMPLATES["gsm8k"], question=f"{data}.question", answer=f"{data}.answer")


def gpqa(data: str, subject: str) -> str:
    return fill(TEMPLATES["gpqa"], problem=f"{data}.problem", solution=f"{data}.solution")


def arc(name: str):
    def render(data: str, subject: str) -> str:
        return fill(
            TEMPLATES[name],
            question=f"{data}.question",
            choices=labelled(f"{data}.choices"),
            answer=f"{data}.answerKey",
        )

    return render


def hellaswag(data: str, subject: str) -> str:
    return fill(
        TEMPLATES["hellaswag"],
        context=f"{data}.ctx",
        endings=lettered(f"{data}.endings"),
        answer=letter(f"try_cast({data}.label AS int)"),
    )


def piqa(data: str, subject: str) -> str:
    return fill(
        TEMPLATES["piqa"],
        goal=f"{data}.goal",
        sol1=f"{data}.sol1",
        sol2=f"{data}.sol2",
        answer=letter(f"{data}.label"),
    )


def truthfulqa(data: str, subject: str) -> str:
    return fill(
        TEMPLATES["truthfulqa"],
        question=f"{data}.question",
        best_answer=f"{data}.best_answer",
        correct_answers=bulleted(f"{data}.correct_answers"),
    )
