"""Schemas of the fact tables."""

from __future__ import annotations

SPAN = "struct<start_byte:int,end_byte:int,start_line:int,end_line:int>"
FILES = "path string, size bigint, content binary"
INVENTORY = "path string, size bigint"
SYMBOL = f"struct<kind:string,name:string,qualified_name:string,signature:string,span:{SPAN},doc:string,modifiers:array<string>,parent_qname:string>"
IMPORT = f"struct<module:string,alias:string,kind:string,span:{SPAN}>"
EXPORT = "struct<name:string,qualified_name:string>"
REFERENCE = f"struct<name:string,qualifier:string,kind:string,span:{SPAN},in_symbol:string>"
LITERAL = f"struct<kind:string,value:string,span:{SPAN}>"
CHUNK = f"struct<qualified_name:string,kind:string,span:{SPAN},text:string,token_estimate:int>"
LOG_EVENT = "ts double, event string, line string, next_offset bigint"
