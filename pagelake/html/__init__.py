"""An HTML parser, serialiser and selector engine for the pages of one Arrow batch."""

from .dom import Comment, Element, Node, Text
from .parser import parse_document
from .select import Selector, SelectorError, select
from .serialize import inner_html, outer_html

__all__ = ["Comment", "Element", "Node", "Selector", "SelectorError", "Text", "inner_html", "outer_html", "parse_document", "select"]
