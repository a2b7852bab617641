"""What can go wrong with the data, as exceptions."""


class LedgerError(Exception):
    """Base of all errors of this package."""


def _kind(name: str, doc: str) -> type[LedgerError]:
    return type(name, (LedgerError,), {"__doc__": doc, "__module__": __name__})


NoRepo = _kind("NoRepo", "The folder holds no store.")
RepoExists = _kind("RepoExists", "The folder holds a store already.")
RefNotFound = _kind("RefNotFound", "No ref of that name.")
InvalidRef = _kind("InvalidRef", "A ref name or pattern that isn't allowed, or no ref at all.")
PathNotFound = _kind("PathNotFound", "The snapshot has no such path.")
ObjectNotFound = _kind("ObjectNotFound", "An object that is referred to isn't stored.")
CorruptObject = _kind("CorruptObject", "An object's content doesn't give its hash.")
UnionConflict = _kind("UnionConflict", "Several inputs hold the same path.")
UnionTypeConflict = _kind("UnionTypeConflict", "A path is a directory in one input and not in another.")
TargetNotEmpty = _kind("TargetNotEmpty", "The target folder holds something.")
LockContention = _kind("LockContention", "Another process holds the lock.")
UnmappedUid = _kind("UnmappedUid", "No range of the map holds the user id.")
UnmappedGid = _kind("UnmappedGid", "No range of the map holds the group id.")
NamespaceParseError = _kind("NamespaceParseError", "A line of an id map holds no 32-bit numbers.")
RemoteNotFound = _kind("RemoteNotFound", "No remote of that name.")
RemoteExists = _kind("RemoteExists", "A remote of that name is there already.")
InvalidEntryName = _kind("InvalidEntryName", "A name that no directory entry can have.")
DuplicateEntryName = _kind("DuplicateEntryName", "Two entries of one directory share a name.")
HardlinkTargetNotFound = _kind("HardlinkTargetNotFound", "A hardlink leads to no path of the snapshot.")
InvalidHashHex = _kind("InvalidHashHex", "Not 64 hexadecimal digits.")
InvalidConflictResolution = _kind("InvalidConflictResolution", "A policy must be error, first or last.")
InvalidObjectType = _kind("InvalidObjectType", "The path can't be exported, or the type has no such name.")
MetadataKeyNotFound = _kind("MetadataKeyNotFound", "The commit has no such metadata key.")
NotFastForward = _kind("NotFastForward", "The destination's head isn't an ancestor of the new one.")
