"""The registered queries of this subpackage and, where SQL can express them, their check SQL."""

from __future__ import annotations

from forumlake.llm import (
    align, ann, chat, decontaminate, exact_dedup, fill_middle, line_dedup, mixing, packing, quality, simhash, toxicity, warc,
)

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_quality": quality.op2_quality,
    "op3_chat_format": chat.op3_chat_format,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_packing": packing.op5_packing,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_mix": mixing.op7_mix,
    "op8_simhash": simhash.op8_simhash,
    "op9_ann": ann.op9_ann,
    "op10_warc_fixity": warc.op10_warc_fixity,
    "op11_fill_middle": fill_middle.op11_fill_middle,
    "op12_align": align.op12_align,
    "op13_decontaminate": decontaminate.op13_decontaminate,
}

CHECKS = {
    "op3_chat_format": chat.ORACLE,
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op11_fill_middle": fill_middle.ORACLE,
    "op13_decontaminate": decontaminate.ORACLE,
}
