"""From one HTML text to cleaned HTML, Markdown, text or JSON, with metadata."""

from .extract import Page, extract_page
from .options import OptionError, Options

__all__ = ["OptionError", "Options", "Page", "extract_page"]
