"""Prompt templates. Any of them can be replaced; ``{name}`` marks a value."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Templates:
    summary_system: str = (
        "Describe what happened on a computer during a short period. The input is text seen on the screen: "
        "keyframes are whole screens, deltas are the parts that changed. Name the task, the content and the "
        "important details. Answer with one JSON object and nothing else: "
        '{"summary": string, "key_topics": [string]}')
    summary_user: str = (
        "Period: {start_time} - {end_time} ({duration})\nApplication: {app_name}\nWindow: {window_title}\n\n"
        "{ocr_samples}")
    relevance_system: str = (
        "Given a prompt and a list of numbered activity summaries, choose the summaries the prompt refers to. "
        'Answer with a JSON array and nothing else: [{"id": number, "reason": string}]. '
        "Answer [] when none fits.")
    relevance_user: str = "Prompt:\n{query}\n\nSummaries:\n{summaries}"
    footnotes_system: str = (
        "Given a prompt and screen text, write at most ten markdown footnotes that carry the facts the prompt "
        "needs, best first, in the form [^1]: (time, application) fact. Write nothing else.")
    footnotes_user: str = "Prompt:\n{query}\n\nScreen text:\n{captures}"
    citations_system: str = (
        "Given a query and screen text, quote the passages that answer the query. Answer with a JSON array and "
        'nothing else: [{"timestamp": ISO-8601, "app_name": string, "window_title": string, '
        '"relevant_text": string, "relevance_explanation": string, "source": "capture"}]')
    citations_user: str = "Query:\n{query}\n\nScreen text:\n{captures}"

    def override(self, **custom: str | None) -> "Templates":
        """Replace templates; empty texts leave the default in place."""
        return replace(self, **{k: v for k, v in custom.items() if v})
