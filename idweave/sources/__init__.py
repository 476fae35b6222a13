"""Sources: file trees and the tables that names are derived from."""
