from revledger.functions.keys import distinct_from, file_safe_key, ident_key
from revledger.functions.lists import as_list
from revledger.functions.refs import ref_name, ref_rest
from revledger.functions.classify import entry_kind

__all__ = ["distinct_from", "file_safe_key", "ident_key", "as_list", "ref_name", "ref_rest", "entry_kind"]
