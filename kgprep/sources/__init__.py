from kgprep.sources.ntriples import (DROPMALFORMED, FAILFAST, PERMISSIVE, parse_ntriples, read_language_datasets,
                                     read_ntriples)
from kgprep.sources.quarantine import Quarantined, read_with_quarantine, reject_reason
from kgprep.sources.tsv import (read_dictionary, read_links, read_literal_mappings, read_quads, read_tsv,
                                read_tuples)

__all__ = ["DROPMALFORMED", "FAILFAST", "PERMISSIVE", "Quarantined", "parse_ntriples", "read_dictionary",
           "read_language_datasets", "read_links", "read_literal_mappings", "read_ntriples", "read_quads", "read_tsv", "read_tuples",
           "read_with_quarantine", "reject_reason"]
