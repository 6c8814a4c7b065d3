"""Licence templates looked for in texts.

Fixed values: phrases and labels of the base set, then wordings of well-known
licences and notices. ``<<optional>> ... <<end>>`` may be left out, ``<<any:n>>`` stands
for up to n words of any kind; all other words are mandatory.
"""

from __future__ import annotations

BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

WORDINGS = {
    "agpl-3.0": "gnu affero general public license <<optional>> version <<end>> 3",
    "all-rights-reserved": "all rights reserved",
    "apache-2.0": "apache license <<optional>> version <<end>> 2 0",
    "apache-2.0-notice": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the "
        "license <<optional>> you may obtain a copy of the license at <<any:12>> <<end>> unless required by applicable law or "
        "agreed to in writing software distributed under the license is distributed on an as is basis without warranties or "
        "conditions of any kind either express or implied"),
    "bsd-notice": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met"),
    "cc-by-4.0": "cc by 4 0",
    "cc-by-nc-4.0": "cc by nc 4 0",
    "cc-by-sa-4.0": "cc by sa 4 0",
    "cc-notice": (
        "licensed under <<optional>> a <<end>> creative commons attribution <<optional>> noncommercial <<end>> "
        "<<optional>> sharealike <<end>> <<optional>> <<any:2>> international <<end>> license"),
    "gpl-3.0": "gnu general public license <<optional>> as published by the free software foundation either <<end>> version 3",
    "gpl-notice": "this <<any:2>> is <<optional>> free software <<any:6>> <<end>> licensed under the gnu general public license",
    "isc-notice": (
        "permission to use copy modify and <<optional>> or <<end>> distribute this software for any purpose with or without fee "
        "is hereby granted"),
    "lgpl-2.1": "gnu lesser general public license <<optional>> version <<end>> 2 1",
    "mit-notice": (
        "permission is hereby granted free of charge to any person obtaining a copy of this <<any:2>> and associated "
        "documentation files the <<any:2>> to deal in the <<any:2>> without restriction <<optional>> including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the <<any:2>> and to permit "
        "persons to whom the <<any:2>> is furnished to do so <<end>> subject to the following conditions"),
    "mit-reference": "<<optional>> released <<end>> under the <<optional>> terms of the <<end>> mit license",
    "mpl-2.0": "mozilla public license <<optional>> v <<end>> <<optional>> version <<end>> 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
