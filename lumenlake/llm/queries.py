"""The queries of this subpackage and the SQL of those that SQL can express."""

from . import bpe, chat, licenses, media, mixing, neighbours, packing, phrases, runs, simhash, substrings, toxicity, warc

QUERIES = {
    f.__name__: f
    for f in (packing.op1_pack, toxicity.op2_toxicity, licenses.op3_licenses, chat.op4_chat, simhash.op5_simhash, warc.op6_warc, substrings.op7_substrings, bpe.op8_bpe, media.op9_matroska, neighbours.op10_neighbours, phrases.op11_phrases, runs.op12_runs, mixing.op13_mix)
}
SQL = {"op4_chat": chat.SQL, "op11_phrases": phrases.SQL}
