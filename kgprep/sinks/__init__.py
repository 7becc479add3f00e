from kgprep.sinks.text import (counted_lines, readable_text, tsv_text, tuple_text, write_counted,
                               write_language_outputs, write_readable, write_tsv, write_tuples)

__all__ = ["counted_lines", "readable_text", "tsv_text", "tuple_text", "write_counted", "write_language_outputs",
           "write_readable", "write_tsv", "write_tuples"]
