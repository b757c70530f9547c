from .querytext import expand_star, query_class, query_name, query_variables, unbound_query_text
from .signatures import label, signature, signature_parts, signature_text, split_signature
from .terms import compress_iri, expand_iri, is_iri, is_literal, is_variable, resolve_iri

__all__ = [
    "compress_iri", "expand_iri", "expand_star", "is_iri", "is_literal", "is_variable", "label",
    "query_class", "query_name", "query_variables", "resolve_iri", "signature", "signature_parts",
    "signature_text", "split_signature", "unbound_query_text",
]
