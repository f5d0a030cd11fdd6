"""Prompt and chat text as column expressions.

The chat markup belongs to a model's tokenizer, not to the data; it is a parameter
here. The default is the widely published ChatML layout.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default instruction of the system turn; the label line follows it.
SYSTEM_TEXT = ("Pick the label that fits the customer's message best and answer with that label alone.\n"
               "Labels: ")


@dataclass(frozen=True)
class ChatTemplate:
    turn_open: str = "<|im_start|>"
    role_end: str = "\n"
    turn_close: str = "<|im_end|>\n"

    def turn(self, role: Column, content: Column) -> Column:
        return F.concat(F.lit(self.turn_open), role, F.lit(self.role_end), content,
                        F.lit(self.turn_close))

    def generation_cue(self) -> Column:
        return F.concat(F.lit(self.turn_open), F.lit("assistant"), F.lit(self.role_end))


CHATML = ChatTemplate()


def system_prompt(label_line: Column, system_text: str = SYSTEM_TEXT) -> Column:
    return F.concat(F.lit(system_text), label_line)


def classification_text(label_line: Column, message: Column, answer: Column | None = None,
                        template: ChatTemplate = CHATML, system_text: str = SYSTEM_TEXT) -> Column:
    """System turn with the label list + user turn; then either the assistant's answer
    (training example) or the generation cue (inference prompt)."""
    parts = [template.turn(F.lit("system"), system_prompt(label_line, system_text)),
             template.turn(F.lit("user"), message)]
    if answer is None:
        parts.append(template.generation_cue())
    else:
        parts.append(template.turn(F.lit("assistant"), answer))
    return F.concat(*parts)
