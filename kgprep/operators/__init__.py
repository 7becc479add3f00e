from kgprep.operators.encode import (bounded_broadcast, encode_literal, encode_many, encode_strict, encode_uri, encoded, id_table,
                                     unmapped)
from kgprep.operators.filters import (as_spo, blank_triples, drop_language, language_rows, literal_object,
                                      literal_triples, objects, predicates, quads_from_triples, subjects,
                                      uri_subject, uri_triples)
from kgprep.operators.ids import (append_relation, as_lookup, dense_ids, entities, entity_dictionary, grow_dictionary,
                                  relation_dictionary, relations, sorted_by_id)
from kgprep.operators.links import (component_labels, grow_components, known_links, link_id_pairs, links_as_triples, merge_ids,
                                    ordered_labels, with_links)
from kgprep.operators.splits import (TRAIN_TEST, TRAIN_VALID_TEST, cut_rows, joint, language_counts, language_part,
                                     shuffle_rank, split)

__all__ = [n for n in dir() if not n.startswith("_")]
