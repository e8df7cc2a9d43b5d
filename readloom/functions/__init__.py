from readloom.functions.strings import bounded_edit_distance, edit_distance, max_substr, read_name, read_name_with_space

__all__ = ["bounded_edit_distance", "edit_distance", "max_substr", "read_name", "read_name_with_space"]
