from kgprep.functions.nodes import (compact, is_skippable, literal_parts,
                                    literal_text, node_kind, node_value, nt_line, nt_node, readable_node,
                                    split_statement)

__all__ = ["compact", "is_skippable", "literal_parts", "literal_text",
           "node_kind", "node_value", "nt_line", "nt_node", "readable_node", "split_statement"]
