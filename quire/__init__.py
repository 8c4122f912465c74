"""A PySpark-native engine for collections of prose documents.

Relational steps are DataFrame plans; trees and binary formats are handled in
deterministic Arrow functions.  ``quire.runtime`` holds what touches the session.
"""
